"""Registered queries and the SQL that must give the same rows.

The test tables hold no sequences, so queries derive them: the nucleotide (or amino-acid) letters of every document's text, in upper
case. Oracles list every window of every sequence and compare it with the pattern, which has nothing in common with how search()
finds its hits.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabets as a
from ..functions import codecs as c
from ..functions import packing as p
from ..operators.search import count_hits, search, search_many
from ..sources import tsv
from .pattern import SearchQuery
from .planner import plan
from .session import scratch, share_code, spread

PROTEIN_LETTERS = "ACDEFGHIKLMNPQRSTVWYBJZXUO"
LETTERS = {"nt": "ACGTNRY", "dna": "ACGT", "rna": "ACGU", "gap": "ACGTN.-", "aa": PROTEIN_LETTERS}


def _class(letters: str) -> str:
    plain = letters.replace("-", "").replace(".", "")
    return plain + plain.lower() + "".join("\\" + x for x in letters if x in "-.")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def records(spark: SparkSession, sf_dir: str, kind: str = "nt") -> DataFrame:
    """name and sequence of every document: its text's letters of that kind."""
    docs = spread(_documents(spark, sf_dir))
    return docs.select(F.col("doc_id").cast("string").alias("name"), F.upper(F.regexp_replace("text", f"[^{_class(LETTERS[kind])}]", "")).alias("sequence"))


def _sql_records(kind: str) -> str:
    return f"r AS (SELECT CAST(doc_id AS VARCHAR) AS record, upper(regexp_replace(text, '[^{_class(LETTERS[kind])}]', '', 'g')) AS s FROM documents)"


def _sql_search(kind: str, m: int, tests: list[tuple[str, str]], circular: bool = False) -> str:
    """All windows of m symbols, once for each (strand, regular expression)."""
    if circular:
        text, starts = f"substr(repeat(s, CAST(ceil((length(s) + {m - 1}) / length(s)) AS INTEGER)), 1, length(s) + {m - 1})", "length(s)"
        guard, end, wraps = "length(s) > 0", f"(i + {m - 1}) % n + 1", f"i + {m - 1} >= n"
    else:
        text, starts, guard, end, wraps = "s", f"length(s) - {m - 1}", f"length(s) >= {m}", f"i + {m}", "false"
    strands = " UNION ALL ".join(f"SELECT '{s}' AS strand, '^{rx}$' AS rx" for s, rx in tests)
    return f"""
WITH {_sql_records(kind)},
e AS (SELECT record, CAST(length(s) AS BIGINT) AS n, {text} AS x, {starts} AS starts FROM r WHERE {guard}),
w AS (SELECT record, n, i, substr(x, CAST(i + 1 AS BIGINT), {m}) AS matched FROM (SELECT record, n, x, unnest(range(CAST(starts AS BIGINT))) AS i FROM e)),
t AS ({strands})
SELECT record, strand, CAST(i + 1 AS BIGINT) AS start, CAST({end} AS BIGINT) AS "end", matched, {wraps} AS circular
FROM w, t WHERE regexp_matches(matched, rx)
"""


@dataclass(frozen=True)
class Find:
    """A search over derived records, and the oracle's regular expressions, written by hand for each strand."""

    kind: str
    query: dict
    tests: tuple[tuple[str, str], ...]
    options: dict | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(records(spark, sf_dir, self.kind), SearchQuery(**self.query), **(self.options or {}))

    def sql(self) -> str:
        return _sql_search(self.kind, len(self.query["pattern"]), list(self.tests), self.query.get("circular", False))


def _find(kind: str, pattern: str, *tests: str, options: dict | None = None, **query) -> Find:
    return Find(kind, {"pattern": pattern, **query}, tuple(zip("+-", tests, strict=False)), options)


_CHUNKS = {"jobs": 4, "chunk_size": 700}
SEARCHES = {
    "exact_nt": _find("nt", "TACA", "TACA"),
    "exact_overlap": _find("nt", "AA", "AA"),
    "exact_literal_n": _find("nt", "TAN", "TAN"),
    "exact_rna": _find("rna", "ATA", "A[TU]A"),
    "exact_gap_literal": _find("gap", "A.", "A\\."),
    "iupac_query": _find("nt", "TRCN", "T[AG]C[ACGT]", ambig_mode="query"),
    "iupac_query_alias": _find("nt", "TRCN", "T[AG]C[ACGT]", ambig=True),
    "iupac_both": _find("nt", "TACA", "[TYN][ARN][CYN][ARN]", ambig_mode="both"),
    "iupac_gap_equiv": _find("gap", "N-", "[ACGT][.-]", ambig_mode="query"),
    "protein_exact": _find("aa", "THE", "THE", sequence_type="amino-acid"),
    "revcomp_search": _find("nt", "TACC", "TACC", "GGTA", revcomp=True),
    "revcomp_iupac": _find("nt", "TRCN", "T[AG]C[ACGT]", "[ACGT]G[CT]A", revcomp=True, ambig_mode="query"),
    "palindrome_both_strands": _find("dna", "TATA", "TATA", "TATA", revcomp=True),
    "circular_search": _find("nt", "TACA", "TACA", circular=True),
    "circular_long_pattern": _find("dna", "N" * 40, "[ACGT]{40}", circular=True, ambig_mode="query"),
    "circular_revcomp": _find("nt", "TRC", "T[AG]C", "G[CT]A", circular=True, revcomp=True, ambig_mode="query"),
    "chunked_exact": _find("nt", "TACA", "TACA", options=_CHUNKS),
    "chunked_iupac": _find("nt", "TRCN", "T[AG]C[ACGT]", "[ACGT]G[CT]A", options=_CHUNKS, revcomp=True, ambig_mode="query"),
    "chunked_circular": _find("nt", "TACA", "TACA", options=_CHUNKS, circular=True),
}
#: Longer than most records: these go without being scanned. Its oracle is that of the last four symbols, moved.
_LONG = _find("dna", "N" * 396 + "TACA", ambig_mode="query")
_LONG_SQL = f"""WITH {_sql_records("dna")}, t AS ({_find("dna", "TACA", "TACA").sql()})
SELECT t.record, t.strand, t.start - 396 AS start, t."end", substr(r.s, t.start - 396, 400) AS matched, false AS circular FROM t JOIN r ON t.record = r.record WHERE t.start > 396"""


def _columns(kind: str, **out: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir, kind).select(F.col("name").alias("record"), *[f(F.col("sequence")).alias(n) for n, f in out.items()])

    return run


def _codes_sql(kind: str, table: dict[str, int]) -> str:
    """The bytes that encode() gives, as hexadecimal digits."""
    pairs = ", ".join(f"'{s}': '{c:02X}'" for s, c in table.items() if s in LETTERS[kind])
    return f"WITH {_sql_records(kind)} SELECT record, CASE WHEN s = '' THEN '' ELSE array_to_string(list_transform(string_split(s, ''), lambda x: (MAP {{{pairs}}})[x]), '') END AS codes FROM r"


#: White space of every sort, put in for blanks by the letter before them.
_ODD_BLANKS = {"e": "\t", "n": "\x1c", "s": "\u2003", "t": "\x85", "r": "\xa0\r\n"}


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.regexp_replace("text", r"[^A-Za-z \n]", "")
    for letter, blank in _ODD_BLANKS.items():
        x = F.replace(x, F.lit(letter + " "), F.lit(letter + blank))
    return spread(_documents(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("record"), a.normalize(x).alias("sequence"))


def _first_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole texts: the first symbol that is no nucleotide, and its place among the text's symbols."""
    bad = a.first_invalid(a.normalize_by_symbol(F.col("text")), a.EXACT)
    return spread(_documents(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("record"), bad["symbol"].alias("symbol"), bad["position"].alias("position"))


def _target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, three sequences: canonical, with ambiguity letters, with gaps."""
    parts = [records(spark, sf_dir, k).select(F.col("name").alias("record"), F.lit(k).alias("kind"), *[p.encoding_name(F.col("sequence"), ambig_mode=m).alias(f"enc_{m}") for m in ("none", "query", "both")]) for k in ("dna", "nt", "gap")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sql_kinds() -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {_sql_records(k)} SELECT record, '{k}' AS kind, s FROM r)" for k in ("dna", "nt", "gap"))


_ENCODING_SQL = f"""WITH q AS ({_sql_kinds()})
SELECT record, kind,
  CASE WHEN regexp_matches(s, '^[ACGTU]*$') THEN '{p.TWO_BIT}' ELSE '{p.EXACT_5BIT}' END AS enc_none,
  CASE WHEN regexp_matches(s, '^[ACGTU]*$') THEN '{p.TWO_BIT_MASK}' WHEN regexp_matches(s, '[-.]') THEN '{p.IUPAC_VALID_GAP}' ELSE '{p.IUPAC_VALID}' END AS enc_query,
  CASE WHEN regexp_matches(s, '^[ACGTU]*$') THEN '{p.TWO_BIT_MASK}' ELSE '{p.IUPAC_5BIT}' END AS enc_both
FROM q"""


def _packed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = lambda kind: F.upper(F.regexp_replace("text", f"[^{_class(LETTERS[kind])}]", ""))
    rows = spread(_documents(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("record"), letters("gap").alias("nt"), letters("aa").alias("aa"))
    size = lambda target: F.octet_length(target["data"]).cast("long")
    targets = {f"bytes_{m}": p.encode_target(F.col("nt"), ambig_mode=m) for m in ("none", "query", "both")} | {"bytes_protein": p.encode_target(F.col("aa"), a.AMINO_ACID)}
    return rows.select("record", *[size(t).alias(n) for n, t in targets.items()])


_SIZE_SQL = f"""WITH {_sql_records("gap")}, aa AS (SELECT CAST(doc_id AS VARCHAR) AS record, CAST(length(regexp_replace(text, '[^{_class(PROTEIN_LETTERS)}]', '', 'g')) AS BIGINT) AS k FROM documents),
q AS (SELECT r.record, CAST(length(s) AS BIGINT) AS n, k, regexp_matches(s, '^[ACGTU]*$') AS canon, regexp_matches(s, '[-.]') AS gap FROM r JOIN aa ON r.record = aa.record)
SELECT record, CASE WHEN canon THEN (n + 3) // 4 ELSE (5 * n + 7) // 8 END AS bytes_none,
  CASE WHEN canon THEN (n + 3) // 4 WHEN gap THEN (n + 3) // 4 + 2 * ((n + 7) // 8) ELSE (n + 3) // 4 + (n + 7) // 8 END AS bytes_query,
  CASE WHEN canon THEN (n + 3) // 4 ELSE (5 * n + 7) // 8 END AS bytes_both, (5 * k + 7) // 8 AS bytes_protein FROM q"""


def _pack2bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "dna").select(F.col("name").alias("record"), F.hex(p.pack_nucleotide_2bit(F.col("sequence"))["data"]).alias("packed"))


_HEX2 = "substr('0123456789ABCDEF', 1 + 4 * (strpos('ACGT', substr(z, CAST(2 * i + 1 AS BIGINT), 1)) - 1) + strpos('ACGT', substr(z, CAST(2 * i + 2 AS BIGINT), 1)) - 1, 1)"
_PACK2_SQL = f"""WITH {_sql_records("dna")}, q AS (SELECT record, rpad(s, CAST((length(s) + 3) // 4 * 4 AS INTEGER), 'A') AS z FROM r)
SELECT record, CASE WHEN z = '' THEN '' ELSE (SELECT string_agg({_HEX2}, '' ORDER BY i) FROM (SELECT unnest(range(length(z) // 2)) AS i)) END AS packed FROM q"""


def _unpack(kind: str, pack: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """Codes of the whole sequence after packing and unpacking, each as two hexadecimal digits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir, kind).select(F.col("name").alias("record"), pack(F.col("sequence")).alias("t"))
        return rows.select("record", F.hex(p.code_bytes(F.col("t"))).alias("codes"))

    return run


def _tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEARCHES["revcomp_search"](spark, sf_dir).select(tsv.line().alias("line"))


def _tsv_sql() -> str:
    return f"""SELECT concat_ws(chr(9), record, strand, start, "end", matched, CAST(circular AS VARCHAR)) AS line FROM ({SEARCHES["revcomp_search"].sql()})"""


_MANY = (SearchQuery("TACA"), SearchQuery("TRCN", ambig_mode="query"), SearchQuery("TACC", revcomp=True))


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_many(records(spark, sf_dir), _MANY)


def _many_sql() -> str:
    parts = [("TACA", "exact_nt"), ("TRCN", "iupac_query"), ("TACC", "revcomp_search")]
    return " UNION ALL ".join(f"SELECT *, '{pattern}' AS pattern FROM ({SEARCHES[name].sql()})" for pattern, name in parts)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_hits(records(spark, sf_dir), SearchQuery("TRCN", revcomp=True, ambig_mode="query"))


def _counts_sql() -> str:
    return f"""WITH {_sql_records("nt")}, h AS ({SEARCHES["revcomp_iupac"].sql()}), t AS (SELECT '+' AS strand UNION ALL SELECT '-')
SELECT r.record, t.strand, CAST(count(h.start) AS BIGINT) AS n_hits FROM r CROSS JOIN t LEFT JOIN h ON h.record = r.record AND h.strand = t.strand GROUP BY ALL"""


def _fasta(name: str, sequence: str) -> Column:
    return F.concat(F.lit(">"), F.col(name), F.lit(" a description\n"), F.regexp_replace(sequence, "(.{70})", "$1\n"))


def _put(rows: DataFrame, text: Column, name: str, gz: bool = False) -> str:
    """The rows' texts as files in a new folder, removed with the session."""
    path = scratch(rows.sparkSession, name)
    rows.select(text.alias("value")).write.option("compression", "gzip" if gz else "none").text(path)
    return path


def _parsed(fmt: str, gz: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """Documents written as files of the format, read back by the data source. FASTA records may be empty. FASTQ records
    spread over lines with blank lines before them; quality lines begin with any symbol, @ and + too."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources.fastx import SequenceFileReader

        rows, text = records(spark, sf_dir, "dna"), _fasta("name", "sequence")
        if fmt == "fastq":
            rows = rows.filter("sequence <> ''")
            body = F.regexp_replace("sequence", "(.{70})", "$1\n")
            text = F.concat(F.lit("\n\n@"), F.col("name"), F.lit("\n"), body, F.lit("\n+\n"), F.translate(body, "ACGT", "@+!>"))
        return SequenceFileReader(_put(rows, text, fmt, gz), fmt).read(spark).select(F.col("name").alias("record"), "sequence")

    return run


def _parsed_sql(empty: bool) -> str:
    return f"WITH {_sql_records('dna')} SELECT record, s AS sequence FROM r" + ("" if empty else " WHERE s <> ''")


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """infer_format() of names made from nations, null where it raises."""
    from ..sources.fastx import infer_format

    def known(name: str) -> str | None:
        try:
            return infer_format(name)
        except ValueError:
            return None

    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.col("n_name"), F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("n_nationkey") % len(_ENDINGS) + 1).cast("int"))).alias("file"))
    share_code(spark)
    return names.select("file", F.udf(known, "string")("file").alias("format"))


_ENDINGS = (".fa", ".FASTA", ".fna.gz", ".FQ.GZ", ".fastq", ".txt", ".faa", "")
_FORMATS_SQL = """WITH q AS (SELECT n_name || (['.fa', '.FASTA', '.fna.gz', '.FQ.GZ', '.fastq', '.txt', '.faa', ''])[n_nationkey % 8 + 1] AS file FROM nation)
SELECT file, CASE WHEN regexp_matches(lower(file), '\\.(fa|fasta|fna|ffn|frn)(\\.gz)?$') THEN 'fasta' WHEN regexp_matches(lower(file), '\\.(fq|fastq)(\\.gz)?$') THEN 'fastq' END AS format FROM q"""

#: A pattern with few hits: what the command line prints goes through the driver.
_RARE = "TACATACA"


def _cli(*argv: str) -> tuple[int, str]:
    from .. import cli

    out = io.StringIO()
    try:
        return cli.run(cli.parse_args(argv), out), out.getvalue()
    except SystemExit as e:
        return int(e.code or 0), out.getvalue()


def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints for all documents as FASTA: the header, then hits."""
    rows = records(spark, sf_dir)
    path = _put(rows, _fasta("name", "sequence"), "cli")
    _, printed = _cli(_RARE, path, "--format", "fasta", "--with-header", "--revcomp", "-j", "2", "--chunk-size", "5000")
    return spark.createDataFrame([(x,) for x in printed.splitlines()], "line string")


_RARE_SEARCH = _find("nt", _RARE, _RARE, "TGTATGTA", revcomp=True)
_LINE_SQL = """concat_ws(chr(9), record, strand, start, "end", matched, CAST(circular AS VARCHAR)) AS line"""
_HEADER_SQL = """SELECT concat_ws(chr(9), 'record', 'strand', 'start', 'end', 'matched', 'circular') AS line"""


def _header_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits written as one file with a header, read back as lines."""
    path = scratch(spark, "tsv")
    tsv.write(_RARE_SEARCH(spark, sf_dir), path, header=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


#: Arguments after the pattern and the input, and the code that the command ends with.
_CALLS = (
    ("ACGT", ""), ("ACGT", "--ambig"), ("ACGT", "--revcomp --circular"), ("ACGT", "--ambig --ambig-mode both"), ("ACGT", "-t amino-acid --revcomp"), ("ACGT", "-t amino-acid --ambig-mode query"),
    ("ACGT", "--jobs 0"), ("ACGT", "--chunk-size 0"), ("ACGT", "--format bam"), ("ACX", ""), ("ACGT", "--version"), ("ACGT", "--unknown"),
)
_CALLS_SQL = f"""SELECT * FROM (VALUES {", ".join(f"('{pattern}', '{args}', {code})" for (pattern, args), code in zip(_CALLS, (0, 0, 0, 2, 2, 2, 2, 2, 2, 1, 0, 2), strict=True))}) AS t(pattern, args, code)"""


def _exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of the command line, whose messages are dropped. Regions stand for records: their letters A, C, G and T."""
    import contextlib

    from .. import cli

    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name"), F.regexp_replace("r_name", "[^ACGT]", "").alias("sequence"))
    path, out = _put(regions, _fasta("name", "sequence"), "cli"), []
    for pattern, args in _CALLS:
        given = args.split() if "--format" in args else [*args.split(), "--format", "fasta"]
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            try:
                code = cli.main([pattern, path, *given])
            except SystemExit as e:
                code = int(e.code or 0)
        out.append((pattern, args, code))
    return spark.createDataFrame(out, "pattern string, args string, code int")


def _udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over the sequences of documents."""
    from ..functions.udtf import register

    register(spark)
    rows = records(spark, sf_dir)
    return spark.sql("SELECT r.name AS record, h.strand, h.start, h.`end`, h.matched, false AS circular FROM {rows} r, LATERAL search_hits(r.sequence, 'TRCN', 'query') h", rows=rows)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = SearchQuery("TRCN", revcomp=True, circular=True, ambig_mode="query")
    return plan(query, jobs=3, chunk_size=900).search(records(spark, sf_dir))


_PLANNED = _find("nt", "TRCN", "T[AG]C[ACGT]", "[ACGT]G[CT]A", revcomp=True, circular=True, ambig_mode="query")

#: Codecs, the letters that they meet, and the fixed code or mask of a letter as a target.
CODECS = {"exact": (c.NucleotideCodec(), "nt", a.EXACT_CODES), "query": (c.IupacNucleotideCodec(), "gap", a.TARGET_MASKS), "both": (c.IupacNucleotideCodec(allow_target_ambiguity=True), "gap", a.IUPAC_MASKS), "protein": (c.ProteinCodec(), "aa", a.PROTEIN_CODES)}


def _symbol_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document and codec, the first, middle and last symbol of the packed target, each read by its place."""
    parts = []
    for name, (codec, kind, _) in CODECS.items():
        rows = records(spark, sf_dir, kind).filter("sequence <> ''").select(F.col("name").alias("record"), codec.encode_target(F.lower("sequence")).column.alias("t"))
        target = c.Target(F.col("t"))
        last = target.length - 1
        parts.append(rows.select("record", F.lit(name).alias("codec"), *[target.symbol_at(i).alias(n) for n, i in (("first", F.lit(0)), ("middle", F.floor(last / 2)), ("last", last))]))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _symbol_sql() -> str:
    one = lambda at, table: f"(MAP {{{', '.join(f'{chr(39)}{s}{chr(39)}: {v}' for s, v in table.items())}}})[substr(s, {at}, 1)]"
    return " UNION ALL ".join(
        f"SELECT * FROM (WITH {_sql_records(kind)} SELECT record, '{name}' AS codec, {one('1', table)} AS first, {one('(length(s) - 1) // 2 + 1', table)} AS middle, {one('length(s)', table)} AS last FROM r WHERE s <> '')" for name, (_, kind, table) in CODECS.items()
    )


def _codec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalize, comparison_text and encode_query by codec objects, and which first symbols are compatible with N as a query
    or target."""
    nt, iupac = CODECS["exact"][0], CODECS["both"][0]
    rows = records(spark, sf_dir, "nt").filter("sequence <> ''").select(F.col("name").alias("record"), F.regexp_replace(F.lower("sequence"), "(..)", "$1 ").alias("x"))
    rows = rows.select("record", nt.normalize(F.col("x")).alias("normal"), nt.comparison_text(F.col("x")).alias("text"), F.hex(nt.encode_query(F.col("x"))).alias("codes"), iupac.encode_target(F.col("x")).column.alias("t"))
    first = c.Target(F.col("t")).symbol_at(F.lit(0))
    return rows.select("record", "normal", "text", "codes", iupac.compatible(first, F.lit(a.IUPAC_MASKS["R"])).alias("meets_r"), nt.compatible(first, F.lit(a.EXACT_CODES["A"])).alias("is_code_0"))


def _codec_texts_sql() -> str:
    meets = "".join(s for s in LETTERS["nt"] if a.IUPAC_MASKS[s] & a.IUPAC_MASKS["R"])
    return f"SELECT t.record, s AS normal, s AS text, codes, contains('{meets}', substr(s, 1, 1)) AS meets_r, false AS is_code_0 FROM ({_codes_sql('nt', a.EXACT_CODES)}) t JOIN (WITH {_sql_records('nt')} SELECT * FROM r) u ON t.record = u.record WHERE s <> ''"


_hexed = lambda f: lambda s: F.hex(f(s))
OTHERS: dict[str, tuple[Callable, str]] = {
    "short_record_prune": (_LONG, _LONG_SQL),
    "normalize": (_normalize, r"SELECT CAST(doc_id AS VARCHAR) AS record, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents"),
    "validate_first_bad": (
        _first_bad,
        r"""WITH q AS (SELECT CAST(doc_id AS VARCHAR) AS record, upper(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', '', 'g')) AS s FROM documents), b AS (SELECT record, s, regexp_extract(s, '[^ACGTURYSWKMBDHVN.-]') AS c FROM q)
SELECT record, CASE WHEN c <> '' THEN c END AS symbol, CASE WHEN c <> '' THEN CAST(length(regexp_extract(s, '^[ACGTURYSWKMBDHVN.-]*')) + 1 AS BIGINT) END AS position FROM b""",
    ),
    "tu_fold": (_columns("rna", sequence=a.nucleotide_exact_text), f"WITH {_sql_records('rna')} SELECT record, replace(s, 'U', 'T') AS sequence FROM r"),
    "protein_text": (_columns("aa", sequence=a.protein_exact_text), f"WITH {_sql_records('aa')} SELECT record, s AS sequence FROM r"),
    "revcomp_text": (_columns("gap", sequence=a.reverse_complement), f"WITH {_sql_records('gap')} SELECT record, translate(reverse(s), 'ACGTU', 'TGCAA') AS sequence FROM r"),
    "encode_exact_codes": (_columns("nt", codes=_hexed(a.encode_nucleotide_exact)), _codes_sql("nt", a.EXACT_CODES)),
    "encode_iupac_masks": (_columns("nt", codes=_hexed(a.encode_nucleotide_iupac_query)), _codes_sql("nt", a.IUPAC_MASKS)),
    "encode_iupac_target": (_columns("nt", codes=_hexed(a.encode_nucleotide_iupac_target)), _codes_sql("nt", a.TARGET_MASKS)),
    "protein_codes": (_columns("aa", codes=_hexed(a.encode_protein_exact)), _codes_sql("aa", a.PROTEIN_CODES)),
    "target_encoding": (_target_encoding, _ENCODING_SQL),
    "packed_size": (_packed_size, _SIZE_SQL),
    "pack2bit_hex": (_pack2bit, _PACK2_SQL),
    "unpack2bit": (_unpack("dna", p.pack_nucleotide_2bit), _codes_sql("dna", a.EXACT_CODES)),
    "unpack_exact_5bit": (_unpack("nt", p.pack_nucleotide_exact_5bit), _codes_sql("nt", a.EXACT_CODES)),
    "unpack_masks_5bit": (_unpack("nt", p.pack_nucleotide_iupac_masks_5bit), _codes_sql("nt", a.IUPAC_MASKS)),
    "unpack_iupac_target": (_unpack("gap", p.pack_nucleotide_iupac_target), _codes_sql("gap", a.TARGET_MASKS)),
    "unpack_protein_5bit": (_unpack("aa", p.pack_protein_5bit), _codes_sql("aa", a.PROTEIN_CODES)),
    "tsv_line": (_tsv, _tsv_sql()),
    "format_infer": (_formats, _FORMATS_SQL),
    "fasta_parse": (_parsed("fasta"), _parsed_sql(True)),
    "fasta_gzip": (_parsed("fasta", gz=True), _parsed_sql(True)),
    "fastq_parse": (_parsed("fastq"), _parsed_sql(False)),
    "fastq_gzip": (_parsed("fastq", gz=True), _parsed_sql(False)),
    "tsv_header_file": (_header_file, f"{_HEADER_SQL} UNION ALL SELECT {_LINE_SQL} FROM ({_RARE_SEARCH.sql()})"),
    "command_line": (_command_line, f"{_HEADER_SQL} UNION ALL SELECT {_LINE_SQL} FROM ({_RARE_SEARCH.sql()})"),
    "command_line_exit_codes": (_exit_codes, _CALLS_SQL),
    "planner_search": (_planned, _PLANNED.sql()),
    "table_function": (_udtf, SEARCHES["iupac_query"].sql()),
    "encode_iupac_alias": (_columns("nt", codes=_hexed(a.encode_nucleotide_iupac)), _codes_sql("nt", a.IUPAC_MASKS)),
    "symbol_at": (_symbol_at, _symbol_sql()),
    "codec_objects": (_codec_texts, _codec_texts_sql()),
    "ext_many_patterns": (_many, _many_sql()),
    "ext_hit_counts": (_counts, _counts_sql()),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEARCHES["chunked_iupac"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**SEARCHES, **{name: run for name, (run, _) in OTHERS.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{name: find.sql() for name, find in SEARCHES.items()}, **{name: sql for name, (_, sql) in OTHERS.items()}}
