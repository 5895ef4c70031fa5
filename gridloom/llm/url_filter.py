"""URL filters through a sorted digest array.

A rule is a host, a path and a verdict; it fits its host and all subdomains where the url's path starts with the rule's,
and the longest that fits wins. The index of the rules is one file in the shared folder: XXH64 digests of
``host + path`` in ascending order, offsets, and the strings themselves. Every executor fetches it once and its tasks
memory-map it. A url's candidate keys are its host and parent domains with each path prefix of a length that
some rule has; all keys of a batch are probed by one vectorised binary search, and what is found counts only if the
stored string is the same, so that digests that collide do no harm.

The index may have at most ``MAX_INDEX_BYTES``; a larger rule set is matched by ``judge_by_join``, where keys meet rules in a
shuffle instead.

Cases: a url that is null or has no ``://`` has an empty host and path and fits no rule; a url that no rule fits is
allowed; an empty path fits no rule with a path; of rules with the same host and path blocking wins, of those equally long (in bytes) the last by bytes; repeated rows are judged each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import shared_path, write_bytes
from .text import tidy

MAX_INDEX_BYTES = 256 << 20
#: What a url gets that no rule fits.
OTHERWISE = "allow"

Rule = tuple[str, str, str]

#: The rules of the query, as (host, path, verdict).
RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    found = _PARTS.search(url or "")
    return (found[1].translate(_FOLD), found[2]) if found else ("", "")


def build_index(rules: list[Rule]) -> bytes:
    """The index file of the rules."""
    blocked = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {verdict!r}")
        key = (host.translate(_FOLD) + path).encode()
        blocked[key] = blocked.get(key, False) or verdict == "block"
    order = sorted((xxhash.xxh64_intdigest(k), k) for k in blocked)
    ends = np.cumsum([0, *(len(k) for _, k in order)])
    lengths = sorted({len(path.encode()) for _, path, _ in rules})
    longest = max((len(host.translate(_FOLD).encode()) for host, _, _ in rules), default=0)
    head = np.array([len(order), len(lengths), ends[-1], longest], "<u8").tobytes()
    return b"".join(
        [head, np.array(lengths, "<u8").tobytes(), np.array([d for d, _ in order], "<u8").tobytes(), ends.astype("<u8").tobytes(), bytes(blocked[k] for _, k in order), *(k for _, k in order)]
    )


class DigestIndex:
    """The memory-mapped index."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        rules, lengths, size, self.longest_host = (int(x) for x in data[:32].view("<u8"))
        at = 32
        self.path_lengths = data[at : (at := at + 8 * lengths)].view("<u8").tolist()
        self.digests = data[at : (at := at + 8 * rules)].view("<u8")
        self.ends = data[at : (at := at + 8 * (rules + 1))].view("<u8")
        self.blocks = data[at : (at := at + rules)]
        self.strings = data[at : at + size]

    def key(self, k: int) -> bytes:
        return self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()

    def candidates(self, host: str, path: str) -> list[bytes]:
        """Keys that a rule for this url may have, the longest first, of equal lengths the last by bytes. No rule's host is longer than ``longest_host``."""
        raw, parts = path.encode(), host.encode()
        tail = max(0, len(parts) - self.longest_host)  # a parent domain of at most that length begins from here on
        hosts = [] if tail else [parts]
        hosts += [parts[m.end() :] for m in re.compile(rb"\.").finditer(parts, max(0, tail - 1))]
        keys = [h + raw[:n] for h in hosts for n in self.path_lengths if n <= len(raw)]
        return sorted(keys, key=lambda k: (len(k), k), reverse=True)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return found
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted))
        for i in hit.tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:  # on through digests that collide
                if self.key(k) == keys[i]:
                    found[i] = k
                    break
                k += 1
        return found


_JUDGED = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row."""
    spark: SparkSession = pages.sparkSession
    index = build_index(rules)
    if len(index) > MAX_INDEX_BYTES:
        return judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), id_col, url_col, otherwise)
    path = shared_path(spark, "url-index")
    name = path.rpartition("/")[2]
    write_bytes(spark, path, index)
    spark.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            each = [index.candidates(h, p) for h, p in parts]
            found = index.find([k for keys in each for k in keys])
            best, at = [], 0
            for keys in each:
                mine = found[at : at + len(keys)]
                at += len(keys)
                fits = mine[mine >= 0]
                best.append(int(fits[0]) if len(fits) else -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([index.key(k).decode() if k >= 0 else None for k in best], pa.string()),
                    pa.array([otherwise if k < 0 else "block" if index.blocks[k] else "allow" for k in best], pa.string()),
                ],
                schema=_JUDGED,
            )

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).mapInArrow(tidy(run), "id long, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """The same for ``rules(host, path, verdict)`` of any number: candidate keys meet the rules in a join."""
    fold = lambda c: F.translate(c, _UPPER, _LOWER)
    keyed = rules.select(F.concat(fold("host"), "path").alias("rule"), F.char_length("path").alias("n"), "verdict")
    keyed = keyed.groupBy("rule").agg(F.max("verdict").alias("rule_verdict"), F.min("n").alias("n"))
    lengths = F.array(*[F.lit(r["n"]) for r in rules.select(F.char_length("path").alias("n")).distinct().sort("n").toLocalIterator()]).cast("array<int>")
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    parted = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), fold(F.coalesce(host, F.lit(""))).alias("host"), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    longest = rules.agg(F.max(F.char_length("host"))).first()[0] or 0
    labels = F.split("host", "\\.")
    # A host of many labels has few parents of a length that some rule's host has.
    most = F.least(F.size(labels), F.lit(longest + 1))
    hosts = F.transform(F.sequence(F.lit(1), most), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    found = parted.select("row", "id", "host", "path", F.explode_outer(keys).alias("key")).join(keyed, F.col("key") == F.col("rule"), "left")
    best = found.groupBy("row", "id", "host", "path").agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(F.octet_length("rule").alias("n"), "rule", "rule_verdict"))).alias("b"))
    return best.select("id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.rule_verdict", F.lit(otherwise)).alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), list(RULES)).withColumnRenamed("id", "page_id")


OP8_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
