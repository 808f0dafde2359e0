import random

from strandex.operators import suffix
from strandex.sources.fasta import fasta_parts, numbered_parts
from strandex.sources.segments import SegmentedIndex
from strandex.sources.stored import StoredIndex
from strandex.sources.tables import from_files
from strandex.streaming.ingest import index_stream


def places(texts, patterns):
    return sorted((n, i, p) for n, s in enumerate(patterns) for i, t in texts.items() for p in range(len(t)) if t.startswith(s, p))


def test_a_stream_is_searched_and_merged(spark, tmp_path):
    rnd = random.Random(4)
    texts = {i: "".join(rnd.choice("1234") for _ in range(40)) + "0" for i in range(6)}
    texts[5] = texts[0]
    table = spark.createDataFrame(list(texts.items()), "doc_id long, enc string")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = str(tmp_path / "index")
    index_stream(stream, base, str(tmp_path / "check"), block_rows=30).awaitTermination()
    index = SegmentedIndex(spark, base, block_rows=30)
    files = len(index.names())
    assert files > 1
    asked = [texts[0][3:9], texts[2][:1], texts[4][10:22], "1" * 30]
    patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    order = sorted(t[p:] for t in texts.values() for p in range(len(t)))
    ranges = {(n, sum(s < p for s in order), sum(s < p or s.startswith(p) for s in order)) for n, p in enumerate(asked)}
    assert sorted(tuple(r) for r in index.occurrences(patterns).collect()) == places(texts, asked)
    assert {tuple(r) for r in index.ranges(patterns).collect()} == ranges
    # A merge that was cut off before its texts were whole does not count; one that was not stands for all others.
    whole = tmp_path / "index/segment=all/stage=text/d=1/_SUCCESS"
    index.merge("all")
    assert index.names() == ["all"] and {tuple(r) for r in index.ranges(patterns).collect()} == ranges
    whole.unlink()
    index.append(table, "again")
    assert index.names() == ["again"] and {tuple(r) for r in index.ranges(patterns).collect()} == ranges
    whole.touch()
    assert index.names() == ["again", "all"]


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\nAC\n")
    (row,) = from_files(spark, str(tmp_path)).collect()
    assert row.raw == ">x\nACGT\nAC\n" and row.name.endswith("a.fa")


def encoded(raw):
    out, skip = [], False
    for c in raw:
        if skip:
            skip = c != "\n"
        elif c == ">":
            skip = True
        elif c in "ACGT\0":
            out.append("0ACTG".index(c) if c != "\0" else 0)
    text = "".join(map(str, out))
    return text if text.endswith("0") else text + "0"


def test_fasta_in_byte_ranges_equals_the_whole(spark, tmp_path):
    rnd = random.Random(6)
    line = lambda n: "".join(rnd.choice("ACGTNacgt") for _ in range(n))
    records = [f">head ACGT {i} {'A' * rnd.randint(0, 900)}\n" + "\n".join(line(rnd.randint(0, 90)) for _ in range(rnd.randint(0, 40))) for i in range(12)]
    files = {"a.fa": "\n".join(records), "b.fa": f"AC>drop ACGT\nGT\r\nC{line(3000)}>no end", "c.fa": ">only a header", "d.fa": "ACGT\nA\0\n", "e.fa": "\n\nA"}
    folder = tmp_path / "in"
    folder.mkdir()
    for name, raw in files.items():
        (folder / name).write_text(raw, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", max(len(r) for r in files.values()) // 8)
    try:
        parts, names = numbered_parts(fasta_parts(spark, str(folder)))
        parts = parts.cache()
        rows = parts.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    named = {r.doc_id: r.name.rsplit("/", 1)[-1] for r in names.collect()}
    texts = {i: encoded(files[n]) for i, n in named.items()}
    assert set(named.values()) == set(files)
    cut = {(i, p): t[1024 * p : 1024 * p + 1024 + suffix.KEY] for i, t in texts.items() for p in range(-(-len(t) // 1024))}
    assert {(r.doc_id, r.part): r.body for r in rows} == cut
    index = StoredIndex(spark, str(tmp_path / "index"), block_rows=1000, parts=parts)
    asked = [texts[i][p : p + n] for i in texts for p, n in ((0, 5), (1000, 60), (1010, 200)) if p + n < len(texts[i])]
    patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    assert sorted(tuple(r) for r in index.occurrences(patterns).collect()) == places(texts, asked)
