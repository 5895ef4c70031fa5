"""Secret scans in DataFrame functions: base patterns, and windows of high entropy.

A pattern's matches and the pieces between them, taken by the same engine, give each match's place by
running lengths. Beside the patterns, candidate strings (long runs of one character class) are scanned by a
sliding window. The window's Shannon entropy is ``log2 W - f / W`` with ``f`` the sum of
``c log2 c`` over its character counts; a step changes two counts, and ``f`` by table look-ups. From the first to
the last window that reaches its class's threshold is a further span, unless the whole candidate is on the allow list (words, a number, one
repeated sign, a UUID, a placeholder, the digits or letters in order) or the span lies within one already found. Patterns
run over whole texts; only texts that have a match pay for its place.

Cases: a null or empty text has no spans; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns by kind, in order, with the group whose length counts and the least length.
BASE: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are runs of ``pattern``; ``alphabet`` holds their signs; a window of ``window`` signs counts from ``bits`` on."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float


ENTROPY: tuple[EntropyClass, ...] = (
    EntropyClass("entropy_hex", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_-])", "0123456789abcdefABCDEF", 24, 3.0),
    EntropyClass("entropy_base64", r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.6),
)

#: Twenty and more letters on end that are no word: six consonants on end, three clusters of consonants in a row, or twice one small letter between capitals.
_NO_WORD = r"(?!.*(?<![A-Za-z])(?=[A-Za-z]{20})(?:[A-Za-z]*(?i:[b-df-hj-np-tv-xz]{6}|[b-df-hj-np-tv-xz]{3}[aeiouy][b-df-hj-np-tv-xz]{3,}[aeiouy][b-df-hj-np-tv-xz]{3})|(?:[A-Za-z]*[A-Z][a-z](?=[A-Z])){2}))"
_PLACEHOLDER = r"(?i:example|placeholder|changeme|xxxxxx|your[_-]?(?:key|token|secret))[0-9]{0,4}"

#: Candidates that as a whole are no secrets although they may look random; a harmless stretch excuses nothing beside it.
ALLOWED = rf"^(?:{_NO_WORD}[A-Za-z_/+-]*(?:{_PLACEHOLDER}[A-Za-z_/+-]*)?|[0-9_/+-]*|[0-9A-Fa-f]{{8}}-(?:[0-9A-Fa-f]{{4}}-){{3}}[0-9A-Fa-f]{{12}}|(.)\1*|(?i:(?:(?:0?123456789|abcdef(?:ghij(?:klmnopqrstuvwxyz)?)?)[_/+-]*)+))$"

_SPAN = "array<struct<start: int, end: int, m: string>>"
_PLACED = "array<struct<start: int, place: int, end: int, kind: string>>"


def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    if "'" in pattern and '"' in pattern:
        return "concat(" + ", ".join(f"r'{p}'" if "'" not in p else f'r"{p}"' for p in _split_quotes(pattern)) + ")"
    return f'r"{pattern}"' if "'" in pattern else f"r'{pattern}'"


def _split_quotes(pattern: str) -> list[str]:
    parts = [""]
    for c in pattern:
        if c in "'\"" and ({"'": '"', '"': "'"}[c] in parts[-1]):
            parts.append("")
        parts[-1] += c
    return parts


#: Elements of an array that are folded at a time; what is put out for each is appended to an array of so many at most.
PART = 128


def _folded(items: str, zero: str, kind: str, step, put, of: str) -> str:
    """What ``put(z, e)`` gives, as arrays of ``of``, for each element e of ``items`` in order, z being ``zero`` after ``step(z, e)`` of all before.

    In parts, each begun with what the parts before come to: appending to one long array copies it every time.
    """
    part = f"slice(a, k * {PART} + 1, {PART})"
    return f"""
      transform(array({items}), a -> flatten(transform(
        aggregate(sequence(0, cast((size(a) - 1) div {PART} as int)), named_struct('z', {zero}, 'o', cast(array() as array<{kind}>)),
          (s, k) -> named_struct('z', aggregate({part}, s.z, (z, e) -> {step("z", "e")}), 'o', concat(s.o, array(s.z))), s -> s.o),
        (before, k) -> aggregate({part}, named_struct('z', before, 'o', cast(array() as {of})),
          (s, e) -> named_struct('z', {step("s.z", "e")}, 'o', concat(s.o, {put("s.z", "e")})), s -> s.o))))[0]"""


def _matches(text: str, pattern: str) -> str:
    p = _quoted(pattern)
    pieces = f"transform(array(named_struct('p', split({text}, {p}, -1), 'm', regexp_extract_all({text}, {p}, 0))), x -> transform(x.m, (y, i) -> named_struct('gap', length(x.p[i]), 'm', y)))[0]"
    places = _folded(pieces, "0", "int", lambda z, e: f"{z} + {e}.gap + length({e}.m)", lambda z, e: f"array(named_struct('start', {z} + {e}.gap, 'end', {z} + {e}.gap + length({e}.m), 'm', {e}.m))", _SPAN)
    return f"case when {text} rlike {p} then {places} else cast(array() as {_SPAN}) end"


def base_spans(text: str, pattern: str, group: int, least: int) -> F.Column:
    """Leftmost non-overlapping matches whose group is long enough, as structs of start, end (code points, exclusive) and the match."""
    return F.expr(f"filter({_matches(text, pattern)}, y -> length(regexp_extract(y.m, {_quoted(pattern)}, {group})) >= {least})")


def entropy_spans(text: str, of: EntropyClass) -> F.Column:
    """For each candidate not on the allow list, from its first to its last window that reaches the threshold."""
    w, size = of.window, len(of.alphabet)
    table = "array(" + ", ".join(f"{c * log2(c) if c else 0.0!r}D" for c in range(w + 2)) + ")"
    most = f"{w * (log2(w) - of.bits) + 1e-9!r}D"
    put = lambda a, k, v: f"concat(slice({a}, 1, {k} - 1), array({v}), slice({a}, {k} + 1, {size}))"
    place = lambda i: f"locate(substr(c.m, {i}, 1), '{of.alphabet}')"
    # Each step takes in sign i and, once the window is full, lets sign i - w go.
    scan = f"""
      aggregate(sequence(1, length(c.m)), named_struct('n', array_repeat(0, {size}), 'f', 0D, 'first', 0, 'last', 0),
        (z, i) -> transform(array(named_struct('k', {place('i')}, 'j', if(i > {w}, {place(f'i - {w}')}, 0))), s ->
          transform(array(named_struct('n', {put('z.n', 's.k', 'z.n[s.k - 1] + 1')}, 'f', z.f + {table}[z.n[s.k - 1] + 1] - {table}[z.n[s.k - 1]])), a ->
            transform(array(if(s.j = 0, a, named_struct('n', {put('a.n', 's.j', 'a.n[s.j - 1] - 1')}, 'f', a.f - {table}[a.n[s.j - 1]] + {table}[a.n[s.j - 1] - 1]))), b ->
              named_struct('n', b.n, 'f', b.f,
                'first', if(i >= {w} and b.f <= {most} and z.first = 0, i - {w} + 1, z.first),
                'last', if(i >= {w} and b.f <= {most}, i, z.last)))[0])[0])[0],
        z -> named_struct('start', c.start + z.first - 1, 'end', c.start + z.last, 'm', if(z.last = 0, '', substr(c.m, z.first, z.last - z.first + 1))))"""
    return F.expr(f"filter(transform(filter({_matches(text, of.pattern)}, y -> not (y.m rlike {_quoted(ALLOWED)})), c -> {scan}), y -> y.m <> '')")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entropy: tuple[EntropyClass, ...] = ENTROPY) -> DataFrame:
    """``id``, an array of ``start, end, m`` for each base kind, and ``spans``: all spans as ``start, place, end, kind``, sorted."""
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = out.select("id", *(base_spans("__text", p, g, n).alias(k) for k, p, g, n in BASE), *(entropy_spans("__text", e).alias(e.kind) for e in entropy))
    as_span = lambda kind, place: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    out = out.withColumn("base", F.array_sort(F.concat(*(as_span(k, i) for i, (k, *_) in enumerate(BASE)))))
    # In order, a span lies within one of an earlier kind if the furthest end of those kinds so far is no less than its own.
    every = F.array_sort(F.concat("base", *(as_span(e.kind, i) for i, e in enumerate(entropy, len(BASE)))))
    furthest = lambda z, e: f"transform({z}, (v, i) -> if(i >= {e}.place, greatest(v, {e}.end), v))"
    kept = lambda z, e: f"if({e}.place < {len(BASE)} or {z}[{e}.place - 1] < {e}.end, array({e}), cast(array() as {_PLACED}))"
    spans = F.expr(_folded("every", f"array_repeat(0, {len(BASE) + len(entropy)})", "array<int>", furthest, kept, _PLACED))
    return out.withColumn("every", every).select("id", *(k for k, *_ in BASE), "base", spans.alias("spans"))


def written(spans: str) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: F.Column | str, spans: F.Column | str, by: str = "[secret]") -> F.Column:
    """The text with every span replaced; spans may overlap."""
    t = F.col(text) if isinstance(text, str) else text
    s = F.col(spans) if isinstance(spans, str) else spans
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(z: F.Column, x: F.Column) -> F.Column:
        gap = F.substring(t, z["at"] + 1, x["start"] - z["at"])
        more = F.when(x["start"] >= z["at"], F.concat(z["out"], gap, F.lit(by))).otherwise(z["out"])
        return F.struct(F.greatest(z["at"], x["end"]).alias("at"), more.alias("out"))

    return F.aggregate(s, none, step, lambda z: F.concat(z["out"], F.substring(t, z["at"] + 1, F.char_length(t))))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
