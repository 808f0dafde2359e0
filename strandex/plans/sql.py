"""Common parts of the SQL that states each query's result."""

DNA = """dna AS (
    SELECT doc_id, translate(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 'ACTG', '1234') || '0' AS enc FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"""
POS = "pos AS (SELECT doc_id, enc, unnest(range(0, length(enc))) AS pos FROM dna)"
SEQ = "seq AS (SELECT doc_id, pos AS idx, CAST(substr(enc, pos + 1, 1) AS BIGINT) AS val FROM pos)"
SA1 = "sa AS (SELECT doc_id, enc, pos, row_number() OVER (PARTITION BY doc_id ORDER BY substr(enc, pos + 1)) - 1 AS sa_pos FROM pos)"


def pat(length: int = 16) -> str:
    return f"""pat AS (
    SELECT doc_id AS pattern_id, doc_id, (doc_id * 7919 + 13) % (length(enc) - {length}) AS start,
           substr(enc, (doc_id * 7919 + 13) % (length(enc) - {length}) + 1, {length}) AS pattern FROM dna WHERE length(enc) > {length} + 1)"""


MUT = "mut AS (SELECT pattern_id, doc_id, substr(pattern, 1, 8) || CAST(CAST(substr(pattern, 9, 1) AS INTEGER) % 4 + 1 AS VARCHAR) || substr(pattern, 10) AS pattern FROM pat)"
BOTH = "both_p AS (SELECT pattern_id, doc_id, pattern FROM pat UNION ALL SELECT -1 - pattern_id, doc_id, pattern FROM mut)"
OCC = "occ AS (SELECT p.pattern_id, s.doc_id, s.pos FROM pos s JOIN both_p p ON substr(s.enc, s.pos + 1, 16) = p.pattern)"


def full(d: int) -> str:
    """Texts filled with terminators to whole groups of d symbols."""
    return f"fil AS (SELECT doc_id, rpad(enc, CAST(ceil(length(enc) / {d}.0) * {d} AS INTEGER), '0') AS enc FROM dna)"


def meta(d: int) -> str:
    return f"met AS (SELECT doc_id, enc, m AS mpos, substr(enc, m * {d} + 1, {d}) AS sym FROM (SELECT doc_id, enc, unnest(range(0, length(enc) // {d})) AS m FROM fil))"


def sa(d: int) -> str:
    return f"sad AS (SELECT doc_id, enc, mpos, row_number() OVER (PARTITION BY doc_id ORDER BY substr(enc, mpos * {d} + 1)) - 1 AS sa_pos FROM met)"


def octal(expr: str, digits: int) -> str:
    """The number that octal digits spell."""
    return "(" + " + ".join(f"CAST(substr({expr}, {i + 1}, 1) AS BIGINT) * {8 ** (digits - 1 - i)}" for i in range(digits)) + ")"


LCP = """CAST(list_reduce([0, 524288, 262144, 131072, 65536, 32768, 16384, 8192, 4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1],
    lambda n, x: CASE WHEN n + x <= length({a}) AND n + x <= length({b}) AND substr({a}, 1, n + x) = substr({b}, 1, n + x) THEN n + x ELSE n END) AS BIGINT)"""


def lcp(a: str, b: str) -> str:
    return LCP.format(a=a, b=b)


def query(*parts: str, of: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + of
