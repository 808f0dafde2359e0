"""Queries of the encoding, meta-symbol and integer functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandex.functions import encoding as E
from strandex.operators import search
from strandex.plans import sql as S
from strandex.sources import fasta
from strandex.sources.tables import dna_docs, fasta_docs, read, shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) under a name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_FASTA = r"""WITH r AS (SELECT doc_id, '>doc' || CAST(doc_id AS VARCHAR) || chr(10) || text AS raw FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT doc_id, translate(regexp_replace(regexp_replace(raw, '>[^\n]*(\n|$)', '', 'g'), '[^ACGT]', '', 'g'), 'ACTG', '1234') || '0' AS enc FROM r"""


_LETTERS = _FASTA + ") SELECT CAST(sum(length(enc) - 1) AS BIGINT) AS symbols, " + ", ".join(f"CAST(sum(length(enc) - length(replace(enc, '{i}', ''))) AS BIGINT) AS {c}" for i, c in enumerate("actg", 1)) + " FROM f"


@query("fasta_parts", _LETTERS.replace("FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)", "FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), f AS ("))
def _fasta_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Nucleotides of all documents, written as FASTA files and read back in byte ranges as numbered parts."""
    path = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    fasta_docs(spark, sf).select("raw").write.text(path)
    count = lambda c: F.sum(F.length("here") - F.length(F.replace("here", F.lit(c)))).cast("long")
    counts = fasta.fasta_parts(spark, path).agg(*(count(str(i)).alias(c) for i, c in enumerate("actg", 1)))
    return counts.select((F.col("a") + F.col("c") + F.col("t") + F.col("g")).alias("symbols"), "a", "c", "t", "g")


@query("fasta_normalize", _FASTA)
def _fasta(spark: SparkSession, sf: str) -> DataFrame:
    return fasta_docs(spark, sf).select("doc_id", E.fasta_normalise(F.col("raw")).alias("enc"))


@query("zero_terminate", "SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS n, true AS ends_ok FROM documents WHERE text IS NOT NULL")
def _zero(spark: SparkSession, sf: str) -> DataFrame:
    ended = read(spark, sf, "documents").filter("text is not null").select("doc_id", E.zero_terminated(F.col("text")).alias("t"))
    return ended.select("doc_id", F.length("t").cast("long").alias("n"), F.col("t").endswith("\x00").alias("ends_ok"))


@query("dna_encode", S.query(S.DNA, of="SELECT doc_id, enc AS value FROM dna"))
def _encode(spark: SparkSession, sf: str) -> DataFrame:
    return dna_docs(spark, sf).select("doc_id", F.col("enc").alias("value"))


@query("dna_decode", S.query(S.DNA, of="SELECT doc_id, replace(translate(enc, '1234', 'ACTG'), '0', chr(92) || '0') AS value FROM dna"))
def _decode(spark: SparkSession, sf: str) -> DataFrame:
    return dna_docs(spark, sf).select("doc_id", E.decode(F.col("enc")).alias("value"))


_PACK = S.query(
    S.DNA,
    "b AS (SELECT doc_id, length(enc) AS n, rpad(list_aggregate(list_transform(string_split(enc, ''), lambda c: lpad(bin(CAST(c AS INTEGER)), 3, '0')), 'string_agg', ''), CAST(ceil(3 * length(enc) / 8.0) * 8 AS INTEGER), '0') AS bits FROM dna)",
    of="""SELECT doc_id, list_aggregate(list_transform(range(0, length(bits) // 4), lambda i: substr('0123456789abcdef',
    CAST(8 * CAST(substr(bits, i * 4 + 1, 1) AS INTEGER) + 4 * CAST(substr(bits, i * 4 + 2, 1) AS INTEGER) + 2 * CAST(substr(bits, i * 4 + 3, 1) AS INTEGER) + CAST(substr(bits, i * 4 + 4, 1) AS INTEGER) + 1 AS INTEGER), 1)), 'string_agg', '') AS value FROM b""",
)


@query("pack3", _PACK)
def _pack(spark: SparkSession, sf: str) -> DataFrame:
    return dna_docs(spark, sf).select("doc_id", E.packed(F.col("enc")).alias("value"))


@query("unpack3", S.query(S.DNA, of="SELECT doc_id, enc AS value FROM dna"))
def _unpack(spark: SparkSession, sf: str) -> DataFrame:
    packed = dna_docs(spark, sf).select("doc_id", "n", E.packed(F.col("enc")).alias("hexed"))
    return packed.select("doc_id", E.unpacked(F.col("hexed"), F.col("n")).alias("value"))


@query("char_at", S.query(S.DNA, of="SELECT doc_id, CAST((doc_id * 7919 + 13) % length(enc) AS BIGINT) AS pos, substr(enc, (doc_id * 7919 + 13) % length(enc) + 1, 1) AS value FROM dna"))
def _char_at(spark: SparkSession, sf: str) -> DataFrame:
    at = dna_docs(spark, sf).withColumn("pos", F.pmod(F.col("doc_id") * 7919 + 13, F.col("n")))
    return at.select("doc_id", "pos", F.substring("enc", (F.col("pos") + 1).cast("int"), F.lit(1)).alias("value"))


@query("slice", S.query(S.DNA, of="SELECT doc_id, CAST(length(enc) // 4 AS BIGINT) AS pos, substr(enc, CAST(length(enc) // 4 + 1 AS BIGINT), CAST(length(enc) // 2 - length(enc) // 4 AS BIGINT)) AS value FROM dna"))
def _slice(spark: SparkSession, sf: str) -> DataFrame:
    cut = dna_docs(spark, sf).withColumn("pos", F.floor(F.col("n") / 4))
    return cut.select("doc_id", "pos", E.slice_of(F.col("enc"), F.col("pos"), F.floor(F.col("n") / 2)).alias("value"))


_ASKED = "CASE doc_id % 3 WHEN 1 THEN substr(letters, 1, 8) || 'N' WHEN 2 THEN lower(substr(letters, 1, 12)) ELSE substr(letters, 1, 16) END AS pattern"


@query("pattern_validate", f"SELECT doc_id, pattern, CASE WHEN regexp_full_match(pattern, '[ACGT]*') THEN translate(pattern, 'ACTG', '1234') END AS value FROM (SELECT doc_id, {_ASKED} FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS letters FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))")
def _validate(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern of each document: as it is, with a letter that is none, or in small letters; only the first kind is valid."""
    letters = dna_docs(spark, sf).select("doc_id", F.translate(F.translate("enc", "0", ""), E.DIGITS, E.LETTERS).alias("letters"))
    kind = F.col("doc_id") % 3
    pattern = F.when(kind == 1, F.concat(F.substring("letters", 1, 8), F.lit("N"))).when(kind == 2, F.lower(F.substring("letters", 1, 12))).otherwise(F.substring("letters", 1, 16))
    return letters.select("doc_id", pattern.alias("pattern")).withColumn("value", E.checked_pattern(F.col("pattern")))


@query("char_histogram", "SELECT code, count(*) AS n FROM (SELECT CAST(unicode(unnest(string_split(text, ''))) AS BIGINT) AS code FROM documents WHERE length(text) > 0) GROUP BY code")
def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    chars = read(spark, sf, "documents").filter("length(text) > 0").select(F.explode(F.split("text", "")).alias("c"))
    # Characters are counted before their codes are looked up.
    return chars.groupBy("c").agg(F.count("*").alias("n")).groupBy(F.ascii("c").cast("long").alias("code")).agg(F.sum("n").alias("n"))


@query("symbol_freq", "SELECT * FROM (" + "\nUNION ALL ".join(f"({S.query(S.DNA, S.full(d), S.meta(d), of=f'SELECT CAST({d} AS BIGINT) AS d, {S.octal("sym", d)} AS num, count(*) AS n FROM met GROUP BY 2')})" for d in range(1, 9)) + ")")
def _symbol_freq(spark: SparkSession, sf: str) -> DataFrame:
    # One pass over the texts for all d.
    each = F.array(*(F.struct(F.lit(d).cast("long").alias("d"), E.meta_symbols(F.col("enc"), d).alias("syms")) for d in range(1, 9)))
    cut = dna_docs(spark, sf).select(F.explode(each).alias("s")).select("s.d", F.explode("s.syms").alias("sym"))
    return cut.groupBy("d", "sym").agg(F.count("*").alias("n")).select("d", E.octal(F.col("sym")).alias("num"), "n")


def _meta_query(name: str, value, oracle_value) -> None:
    """One query over the meta-symbols of 3 letters."""
    d = 3
    oracle = S.query(S.DNA, S.full(d), S.meta(d), of=f"SELECT doc_id, CAST({d} AS BIGINT) AS d, mpos, {oracle_value} AS value FROM met")

    @query(name, oracle)
    def _run(spark: SparkSession, sf: str) -> DataFrame:
        each = dna_docs(spark, sf).select("doc_id", F.posexplode(E.meta_symbols(F.col("enc"), d)).alias("mpos", "sym"))
        return each.select("doc_id", F.lit(d).cast("long").alias("d"), F.col("mpos").cast("long").alias("mpos"), value(F.col("sym")).alias("value"))


_meta_query("meta_symbols", lambda s: s, "sym")
_meta_query("meta_number", E.octal, S.octal("sym", 3))
_meta_query("meta_rev_number", lambda s: E.octal(F.reverse(s)), S.octal("reverse(sym)", 3))
_meta_query("meta_reverse", F.reverse, "reverse(sym)")
_meta_query("meta_compare", lambda s: F.when(E.octal(s) < E.octal(F.reverse(s)), F.lit(-1)).when(s == F.reverse(s), F.lit(0)).otherwise(F.lit(1)).cast("long"), "CAST(CASE WHEN sym < reverse(sym) THEN -1 WHEN sym = reverse(sym) THEN 0 ELSE 1 END AS BIGINT)")


@query("int_math", "SELECT p_partkey AS v, CAST((p_partkey + 6) // 7 AS BIGINT) AS div_up, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE length(bin(p_partkey)) END AS BIGINT) AS log2_up, CAST(8 * ((p_partkey + 7) // 8) AS BIGINT) AS align8 FROM part")
def _int_math(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("p_partkey")
    return read(spark, sf, "part").select(v.alias("v"), E.div_up(v, F.lit(7)).alias("div_up"), E.bit_length(v).alias("log2_up"), E.align8(v).alias("align8"))


@query("bit_reverse", "SELECT p_partkey AS v, CAST(list_sum(list_transform(range(0, 20), lambda i: ((p_partkey >> i) & 1) << (19 - i))) AS BIGINT) AS reversed FROM part")
def _bit_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("v"), E.bits_reversed(F.col("p_partkey"), 20).alias("reversed"))


@query("sample_patterns", S.query(S.DNA, S.pat(), of="SELECT pattern_id, CAST(start AS BIGINT) AS start, pattern FROM pat"))
def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return search.sample_patterns(dna_docs(spark, sf)).select("pattern_id", "start", "pattern")


def _split_sql(d: int) -> str:
    left = f"rpad(reverse(substr(pattern, 1, k)), {d}, '1')"
    right = f"rpad(substr(pattern, k + 1), CAST(ceil((16 - k) / {d}.0) * {d} AS INTEGER), '0')"
    return S.query(S.DNA, S.pat(), of=f"SELECT pattern_id, CAST({d} AS BIGINT) AS d, CAST(k AS BIGINT) AS k, {S.octal(left, d)} AS left_num, {right} AS \"right\", CAST(length({right}) - (16 - k) AS BIGINT) AS pad FROM pat, range(0, {d}) AS r(k)")


@query("pattern_split", "SELECT * FROM (" + "\nUNION ALL ".join(f"({_split_sql(d)})" for d in range(2, 9)) + ")")
def _split(spark: SparkSession, sf: str) -> DataFrame:
    patterns = search.sample_patterns(dna_docs(spark, sf))
    joined = search.splits(patterns, 2)
    for d in range(3, 9):
        joined = joined.unionByName(search.splits(patterns, d))
    return joined


_MEAN = """WITH m AS (SELECT o_orderpriority AS grp, CAST(floor(sum(o_custkey) / count(*)) AS BIGINT) AS mean FROM orders GROUP BY 1)
SELECT grp, mean, CAST(floor(sqrt(floor(sum((o_custkey - mean) * (o_custkey - mean)) / count(*)))) AS BIGINT) AS disp FROM orders JOIN m ON grp = o_orderpriority GROUP BY grp, mean"""


@query("mean_disp", _MEAN)
def _mean_disp(spark: SparkSession, sf: str) -> DataFrame:
    """Integer mean and spread, both rounded down."""
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("x"))
    means = rows.groupBy("grp").agg(F.floor(F.sum("x") / F.count("*")).alias("mean"))
    spread = F.floor(F.sqrt(F.floor(F.sum((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))) / F.count("*"))))
    return rows.join(F.broadcast(means), "grp").groupBy("grp", "mean").agg(spread.alias("disp"))


_SECTIONS = """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
s AS (SELECT (o_orderkey - lo) * 10 // (hi - lo + 1) AS section, sum(o_custkey) AS s, count(*) AS n FROM orders, b GROUP BY 1)
SELECT CAST(section AS BIGINT) AS section, CAST(floor(sum(s) OVER w / sum(n) OVER w) AS BIGINT) AS mean FROM s WINDOW w AS (ORDER BY section)"""


@query("sectioned_means", _SECTIONS)
def _sectioned_means(spark: SparkSession, sf: str, sections: int = 10) -> DataFrame:
    """Integer means of growing prefixes of a list, cut into sections of its key: one row a section is all that the window sees."""
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("x"))
    ends = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    section = F.floor((F.col("key") - F.col("lo")) * sections / (F.col("hi") - F.col("lo") + 1))
    sums = rows.join(F.broadcast(ends)).groupBy(section.alias("section")).agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    so_far = Window.orderBy("section")
    return sums.select("section", F.floor(F.sum("s").over(so_far) / F.sum("n").over(so_far)).alias("mean"))
