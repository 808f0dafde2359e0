import hashlib
import re

import numpy as np
import pytest

from strandex.llm import infilling, registry


def brute(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(s in text for s in infilling.SENTINELS):
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one\ntwo", "one\ntwo\n", "é\nüß\n\U0001f600\U0001f600\nz", "a <P> b\nc", "<S>\n<M>\n", "x\n<P", "S>\ny", "<\n<S\n>\n<M\n", "a\r\nb\r\n \t\n",
    "line é\n" * 1000, "\n" * 777, "ü" * 300_000, ("w" * 9_000 + "\n") * 70 + "end", "".join(f"{i}€\n" for i in range(200)),
]


def test_query_against_brute_force(spark, make_docs, tmp_path):
    rows = [(17 * i + j, t) for i, t in enumerate(TEXTS) for j in range(4)] + [(3, "one\ntwo\nthree")] * 3 + [(None, "a\nb\nc\n"), (None, None), (-5, "m\nn")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.op12_fill_in_middle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert all(r[5] == r[6] for r in got if r[2] == "plain") and {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("every", [1, 2, 3, 64, 1000])
@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_every_cut_of_the_index(text, every, monkeypatch):
    monkeypatch.setattr(infilling, "_BLOCK", 1 << 10)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    index = infilling.UnitIndex(np.frombuffer(text.encode(), np.uint8), every)
    assert index.n == len(lines) and len(index.units) <= 1 + len(lines) // every
    for cut in {0, 1, len(lines) // 2, len(lines) - 1, len(lines), every, every + 1} & set(range(len(lines) + 1)):
        head = "".join(lines[:cut])
        assert index.cut(cut) == (len(head.encode()), len(head))


def test_rates_forms_and_an_empty_table(make_docs):
    docs = make_docs([(i, f"a{i}\nb\nc\n") for i in range(200)])
    rows = infilling.fill_in_middle(docs, fim_percent=30, spm_percent=0)
    forms = [r.form for r in rows.collect()]
    assert set(forms) == {"plain", "psm"} and 30 < forms.count("psm") < 90
    restored = rows.select(infilling.restored_text(rows.output, rows.form).alias("t")).collect()
    assert sorted(r.t for r in restored) == sorted(f"a{i}\nb\nc\n" for i in range(200))
    assert infilling.fill_in_middle(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        infilling.fill_in_middle(docs, sentinels=("a", "ab", "b"))
