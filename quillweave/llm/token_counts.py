"""Token counts with a digest cache.

A text's count is stored under the digests of its content and of the tokenizer's file. A run joins the digests of its
texts with the store, encodes one text for each digest that is missing, and appends the new counts: equal texts are
encoded once, and a second run over a grown corpus encodes only what is new. The row of a missing digest is known by the
file and place where it lies, so that texts aren't moved, and rows that share a doc_id or have none are told apart.

Content is normalised before it is digested by taking null for empty and nothing else: the counts have to be those of
the texts as they are, and no change of letters or white space leaves all of a tokenizer's counts as they were.

Encoding is the library's, word by word: where no piece of the vocabulary spans the start of a space or a line end,
a text's pieces are those of its parts, so that counts of parts seen before are looked up. ``Counter`` checks this on
the vocabulary and otherwise encodes whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, emit, placed, scratch, slices, table, utf8

#: Bytes of parts that a worker remembers, about; beyond it forgets all and starts anew.
MEMO = 48 << 20
_PART = re.compile(rb" +[^ \n]*|\n[^ \n]*")


class Counter:
    """Counts pieces as sentencepiece encodes a text, without begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.memo: dict[bytes, int] = {}
        self.held = 0
        self.by_part = not any("▁" in p.lstrip("▁") or "\n" in p or " " in p for p in pieces)
        probes = ["", " ", "\n", "a b", "a  b", "\na\nb", " a\n b ", "A b\té \r\n▁x", "é ﬁ １ Ω"]
        self.by_part = self.by_part and self.count([x.encode() for x in probes]) == self.whole(probes)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    @staticmethod
    def parts(text: bytes) -> list[bytes]:
        """A word stands for itself after one space; other parts start with all their spaces or with a line end."""
        out = text.replace(b"\n", b" \n").split(b" ")
        if b"" in out:
            out = [x[1:] if x[:1] == b" " and x[1:2] not in (b" ", b"") else x for x in _PART.findall(text if text[:1] == b"\n" else b" " + text)]
            if text[:1] == b"\n":
                out.append(b" ")  # the space that the library puts before a text is then a piece of its own
        return out

    def learn(self, parts: list[bytes]) -> None:
        """The library puts a space before what it encodes, which makes a piece of its own before a line end."""
        n = self.whole([(x[1:] if x[:1] == b" " else x).decode() for x in parts])
        size = sum(map(len, parts)) + 130 * len(parts)  # an object and an entry of a dictionary each
        if self.held + size > MEMO:
            self.memo.clear()
            self.held = 0
        self.held += size
        self.memo.update((x, k - (x[:1] == b"\n") + (x == b" ")) for x, k in zip(parts, n))

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.by_part:
            return self.whole([x.decode() for x in texts])
        get, out, late = self.memo.get, [], []
        for k, text in enumerate(texts):
            if not text or b"\xe2\x96\x81" in text:  # the library's mark of a space
                out.append(len(self.model.encode(text.decode())))
                continue
            parts = self.parts(text)
            n = list(map(get, parts))
            if None in n:
                late.append((k, parts))
                out.append(0)
            else:
                out.append(sum(n))
        if late:
            new = {p for _, parts in late for p in parts if p not in self.memo}
            self.learn(list(new))
            if any(p not in self.memo for _, parts in late for p in parts):  # all was forgotten on the way
                self.learn(list({p for _, parts in late for p in parts}))
            for k, parts in late:
                out[k] = sum(map(get, parts))
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                raw, at = data[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                n = count([raw[a:b] for a, b in zip(at[:-1], at[1:])])
                yield pa.record_batch([batch.column("digest").slice(i, j - i), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text); new counts are appended to cache.

    cache is a folder in shared storage: Parquet of (tokenizer, digest, n_tokens), made where it is missing. The file
    of the tokenizer is at path on every machine. A null text counts as empty and has no tokens; a very long one is
    encoded whole; equal texts are encoded once and share one cache entry; repeated rows are kept; an empty table gives
    an empty result. Other columns, of whatever name, are ignored.
    """
    spark = docs.sparkSession
    home = scratch(spark, "tokens")
    version = hashlib.sha256(open(path, "rb").read()).hexdigest()
    schema = "tokenizer string, digest string, n_tokens long"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    files = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(jvm):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(cache)
    text = F.coalesce("text", F.lit(""))
    rows, file, row = placed(docs, home)
    rows = rows.select("doc_id", text.alias("text"), file, row)
    n_bytes, digest = F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    digests = table(rows.select("doc_id", n_bytes, digest, F.col(file).alias("file"), F.col(row).alias("row")), f"{home}/digests")
    stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    missing = digests.groupBy("digest").agg(F.min(F.struct("file", "row")).alias("at")).join(stored, "digest", "left_anti")
    todo = emit(rows, file, row, missing.select("at.file", "at.row", F.lit(1).alias("n")), home)
    new = todo.select(digest, "text").transform(arrow, _encode(path), "digest string, n_tokens long")
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = digests.join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
