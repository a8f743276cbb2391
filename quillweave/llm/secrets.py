"""Secrets found once for each content, with a ledger of what has been scanned by which rule.

A text is known by the digest of its bytes: all versions of all paths that hold the same text are one blob. The ledger, in
shared storage, says which blobs were scanned by which version of which rule, and where they found something. A run looks for
pairs of blob and rule version that the ledger lacks, reads one text for each blob among them, found by file and place without
moving texts, scans it with the rules that it lacks, stores the findings, then the pairs, and joins the findings back to all
rows. So a second run over a grown table scans what is new, and a new version of a rule scans all blobs with that rule alone.

A pair is in the ledger only when its findings are: a run that breaks off between the two writes scans those blobs again, and
findings that are stored twice count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, emit, placed, scratch, table


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int  # the group that is measured
    least: int  # its least length
    base: bool = True
    fold: bool = False  # letters of the pattern in either case


# The first three rules are given; matches that are too short are dropped after they were found.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, fold=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, base=False),
)
#: Rules of a run at most: which of them a blob lacks is one number.
MOST = 62
_FOUND = "blob string, kind string, version int, first array<long>, last array<long>"


def finder(rule: Rule):
    """text -> (starts, ends) in code points of a rule's leftmost matches that don't overlap and are long enough."""
    find = re.compile(rule.pattern, re.A | (re.I if rule.fold else 0)).finditer
    group, least = rule.group, rule.least

    def run(text: str) -> tuple[list[int], list[int]]:
        spans = [m.span() for m in find(text) if m.end(group) - m.start(group) >= least]
        return [a for a, _ in spans], [b for _, b in spans]

    return run


def _scan(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [finder(r) for r in rules]
        for batch in batches:
            out: list[tuple] = []
            for blob, text, lacks in zip(batch.column("blob"), batch.column("text"), batch.column("lacks").to_pylist()):
                text = text.as_py()
                for k, (rule, find) in enumerate(zip(rules, finders)):
                    if lacks >> k & 1:
                        first, last = find(text)
                        if first:
                            out.append((blob.as_py(), rule.kind, rule.version, first, last))
            if out:
                types = pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), types)], ["blob", "kind", "version", "first", "last"])

    return run


def _stored(spark, path: str, schema: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, blob, n_assign ... (a count for each base rule), base_sha256, spans for every row of docs (doc_id, text).

    ledger is a folder in shared storage, made where it is missing: scanned (blob, kind, version) and findings (blob, kind,
    version, first, last: arrays). A row is a version of what doc_id names; rows of equal texts share a blob. base_sha256 is the
    digest of the base rules' kind:start:end, by start, then in order of rules, joined by commas; spans holds those of all
    rules likewise. Starts and ends count code points, the end isn't in the match. A null text counts as empty and has no
    spans; a very long one is scanned whole; repeated rows are kept; an empty table gives an empty result. Other columns, of
    whatever name, are ignored.
    """
    if len(rules) > MOST or len({r.kind for r in rules}) < len(rules):
        raise ValueError(f"at most {MOST} rules, of one version each")
    spark = docs.sparkSession
    home = scratch(spark, "secrets")
    known = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
    rows, file, row = placed(docs, home)
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), file, row)
    blob = F.sha2(F.col("text").cast("binary"), 256)
    paths = table(rows.select("doc_id", blob.alias("blob"), F.col(file).alias("file"), F.col(row).alias("row")), f"{home}/paths")

    scanned = _stored(spark, f"{ledger}/scanned", "blob string, kind string, version int")
    bit = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        bit = F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(1 << k)).otherwise(bit)
    has = scanned.groupBy("blob").agg(F.bit_or(bit).alias("has"))
    one = paths.groupBy("blob").agg(F.min(F.struct("file", "row")).alias("at")).join(has, "blob", "left")
    lacks = F.lit((1 << len(rules)) - 1).bitwiseAND(F.bitwise_not(F.coalesce("has", F.lit(0).cast("long"))))
    todo = table(one.select("blob", "at", lacks.alias("lacks")).where("lacks <> 0"), f"{home}/todo")

    texts = emit(rows, file, row, todo.select("at.file", "at.row", F.col("lacks").alias("n")), home, code="lacks")
    new = texts.select(blob.alias("blob"), "text", "lacks").transform(arrow, _scan(rules), _FOUND)
    _stored(spark, f"{ledger}/findings", _FOUND)
    new.write.mode("append").parquet(f"{ledger}/findings")
    missing = F.array(*[F.when(F.col("lacks").bitwiseAND(1 << k) != 0, x) for k, x in enumerate(known)])
    done = todo.select("blob", F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("rule"))
    done.select("blob", "rule.kind", "rule.version").write.mode("append").parquet(f"{ledger}/scanned")

    place = F.lit(None).cast("int")
    for k, r in enumerate(rules):
        place = F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(k)).otherwise(place)
    found = spark.read.schema(_FOUND).parquet(f"{ledger}/findings").withColumn("place", place).where("place is not null")
    found = found.groupBy("blob", "place").agg(F.first("first").alias("first"), F.first("last").alias("last"))  # stored twice, counted once
    span = F.transform(F.arrays_zip("first", "last"), lambda x: F.struct(x["first"].alias("first"), F.col("place").alias("place"), x["last"].alias("last")))
    found = found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(span))).alias("all"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [k for k, r in enumerate(rules) if r.base]

    def shown(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["place"]), x["first"], x["last"])), ",")

    out = paths.select("doc_id", "blob").join(found, "blob", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<first:bigint,place:int,last:bigint>>")))
    counts = [F.size(F.filter("all", lambda x: x["place"] == k)).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    return out.select("doc_id", "blob", *counts, F.sha2(shown(F.filter("all", lambda x: x["place"].isin(base))).cast("binary"), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"))


def _positions(kind: str, place: int, pattern: str, least: str) -> str:
    """SQL of a kind's spans: what lies between matches and the matches, one after the other, tell where they are."""
    q = pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, begun AS first, begun + length(m) AS last FROM (
      SELECT doc_id, m, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS begun FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, '{q}') AS ms, string_split_regex(text, '{q}') AS gaps FROM texts))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {least}"""


_KEYS = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _KEYS + r"""["']?\x20*[:=]\x20*["']?"""
_ALL = ", ".join(
    f"{name} AS ({sql})"
    for name, sql in (
        ("assign", _positions("assign", 0, _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_ASSIGN.replace(chr(39), chr(39) * 2)}', '')) >= 12")),
        ("access", _positions("access", 1, r"AKIA[A-Z0-9]+", "length(m) >= 18")),
        ("hex", _positions("hex", 2, r"[0-9a-f]{16,}", "true")),
        ("pem", _positions("pem", 3, RULES[3].pattern, "true")),
        ("jwt", _positions("jwt", 4, RULES[4].pattern, "length(m) >= 40")),
    )
)
#: doc_ids are unique in documents.
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_ALL},
found AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM pem UNION ALL SELECT * FROM jwt),
shown AS (SELECT doc_id, place, first, kind || ':' || first::BIGINT || ':' || last::BIGINT AS span FROM found),
sums AS (SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
  string_agg(span, ',' ORDER BY first, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY first, place) AS spans FROM shown GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN sums USING (doc_id)
"""
