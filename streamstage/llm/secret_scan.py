"""Secrets in texts: certain ones by pattern, weak ones only where parts that complete each other stand in one scope.

All of it is column expressions; nothing is shuffled. The work grows with a text's length and its number of matches, not
with their squares: running sums go block by block. No pattern repeats a group, so that none recurses once a repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import text_of

# The certain kinds (rank for ties, pattern, group that must be long, least length).
BASE = {
    "assign": (0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (2, r"[0-9a-f]+", 0, 24),
}
# The weak kinds and the part that each stands for.
WEAK = {
    "ident": (3, r"""(?i:user(?:name)?|login|account|client_?id|access_?key_?id|tenant)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}|ASIA[A-Z0-9]{16,}""", "id"),
    "weak": (4, r"""(?i:pwd|pass|passphrase|auth|bearer|credential|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}|(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""", "secret"),
    "endpoint": (5, r"""[a-z][a-z0-9+]{1,15}://[^\s"'<>]{3,}|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9-]""", "endpoint"),
}
#: The part that a certain kind stands for.
PART = {"assign": "secret", "access": "id", "hex": "secret"}
#: A scope ends at a blank line. No pattern takes a line's end, so that no match reaches over one.
SCOPE_END = r"\n[\x20\t]*+\n"
#: Matches whose positions are summed side by side; code points of text that are cut out of together.
TOGETHER, CHUNK = 512, 4096

_MATCH = "array<struct<start:long,rank:int,end:long,kind:string,part:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value``, which is computed once, as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, more: str) -> str:
    """SQL for the running totals of an array of longs; ``more`` adds {x} to the total {a} (null at first)."""
    total = more.format(a="try_element_at(o, -1)", x="x")
    onward = more.format(a="element_at(o, -1)", x="element_at(t, -1)")
    moved = more.format(a="y", x="x")
    empty = "cast(array() as array<bigint>)"
    inner = f"transform(sequence(0, (size(v) - 1) div {TOGETHER}), k -> aggregate(slice(v, k * {TOGETHER} + 1, {TOGETHER}), {empty}, (o, x) -> array_append(o, {total})))"
    before = f"aggregate(slice(b, 1, size(b) - 1), cast(array(null) as array<bigint>), (o, t) -> array_append(o, {onward}))"
    return _let(values, "v", f"if(size(v) = 0, {empty}, {_let(inner, 'b', f'flatten(zip_with(b, {before}, (t, y) -> transform(t, x -> {moved})))')})")


_SUM = "coalesce({a}, 0L) + {x}"
_LARGEST = "greatest({a}, {x})"


def _matches(text: str, pattern: str) -> str:
    """SQL for the matches' (start, end, hit) in code points: the gaps of a split between the matches' own lengths."""
    p = _quoted(pattern)
    ends = _running("zip_with(slice(z.g, 1, size(z.h)), z.h, (g, h) -> cast(length(g) + length(h) as bigint))", _SUM)
    return _let(f"named_struct('g', split({text}, {p}, -1), 'h', regexp_extract_all({text}, {p}, 0))", "z", f"zip_with({ends}, z.h, (e, h) -> named_struct('start', e - length(h), 'end', e, 'hit', h))")


def _placed(matches: str, rank: int, kind: str, part: str) -> str:
    return f"transform({matches}, m -> named_struct('start', m.start, 'rank', {rank}, 'end', m.end, 'kind', '{kind}', 'part', '{part}'))"


def _spans(text: str, kind: str) -> str:
    """SQL for the spans of one certain kind."""
    rank, pattern, group, least = BASE[kind]
    if kind == "assign":
        matches = f"filter({{}}, m -> length(regexp_extract(m.hit, {_quoted(pattern)}, {group})) >= {least})"
    else:  # a run is maximal, so that its least length may stand in the pattern
        pattern, matches = pattern[:-1] + f"{{{least - (4 if kind == 'access' else 0)},}}", "{}"
    return f"if({text} rlike {_quoted(pattern)}, {_placed(matches.format(_matches(text, pattern)), rank, kind, PART[kind])}, cast(array() as {_MATCH}))"


def _linked(text: str) -> str:
    """SQL for a text's weak spans of which the same scope has a part that completes them.

    Scopes are the intervals between blank lines; each is searched on its own, so that its parts are joined to it and to
    each other by lying in it.
    """
    empty = f"cast(array() as {_MATCH})"
    weak = ", ".join(f"if(s rlike {_quoted(p)}, {_placed(_matches('s', p), rank, kind, part)}, {empty})" for kind, (rank, p, part) in WEAK.items())
    certain = ", ".join(_spans("s", kind) for kind in BASE)
    has = lambda part: f"exists(p.found, f -> f.part = '{part}')"
    kept = f"filter(p.found, f -> f.rank >= 3 and if(f.part = 'secret', p.id or p.endpoint, p.secret))"
    known = _let(f"named_struct('found', concat(l, {certain}))", "p", _let(f"named_struct('found', p.found, 'id', {has('id')}, 'endpoint', {has('endpoint')}, 'secret', {has('secret')})", "p", kept))
    each = f"(s, i) -> {_let(f'concat({weak})', 'l', f'if(size(l) = 0, l, {known})')}"
    ends = _matches(text, SCOPE_END)
    moved = "transform(f, m -> named_struct('start', m.start + o, 'rank', m.rank, 'end', m.end + o, 'kind', m.kind, 'part', m.part))"
    begins = _let(ends, "e", "concat(array(0L), transform(e, m -> m.end))")
    return f"flatten(zip_with(transform(split({text}, {_quoted(SCOPE_END)}, -1), {each}), {begins}, (f, o) -> {moved}))"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, base, spans, n_assign, n_access, n_hex): the rows of ``docs`` as structs, which no name can clash with, and
    arrays of (start, rank, end, kind, part), sorted by start, then rank.

    Positions are code points, the end is exclusive. ``base`` has the certain kinds; ``spans`` adds weak secrets,
    identifiers and endpoints, each only when a part that completes it stands in the same scope (no blank line between
    them, however far): a secret needs an identifier or an endpoint, these need a secret. Certain finds count as parts
    too. Null texts count as empty; every row gives one row, repeated ones too, and none sees another.
    """
    # The distinct steps keep Spark from evaluating a pattern once for each use.
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text_col).alias("text"))
    some = "|".join(f"(?:{p})" for _, p, _ in WEAK.values())
    more = F.expr(f"if(text rlike {_quoted(some)}, {_linked('text')}, cast(array() as {_MATCH}))")
    out = out.select("row", *[F.expr(_spans("text", k)).alias(k) for k in BASE], more.alias("more"))
    out = out.withColumn("base", F.array_sort(F.concat(*BASE)))
    out = out.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.concat("base", "more"))).otherwise(F.col("base")))
    return out.select("row", "base", "spans", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE])


def spans_string(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, how many certain finds of each kind, their digest, and all spans as a string."""
    found = scan(docs.select(id_col, text_col), text_col)
    return found.select(F.col(f"row.{id_col}").alias(id_col), *[f"n_{k}" for k in BASE], F.sha2(spans_string("base"), 256).alias("base_sha256"), spans_string("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span (overlapping ones as one) replaced by ``mask``; rows without finds stay as they are,
    and so do all other columns, whatever their names. Each row is looked at alone, repeated ones too."""
    found = scan(docs, text_col).select("row", F.col(f"row.{text_col}").alias("text"), "spans")
    # A run of spans that touch ends where the largest end so far lies before the next start.
    found = found.withColumn("reach", F.expr(_running("transform(spans, s -> s.end)", _LARGEST)))
    begins = F.expr("concat(array(0L), transform(filter(arrays_zip(reach, slice(spans, 2, size(spans))), z -> z.`1`.start is null or z.`1`.start > z.reach), z -> z.reach))")
    ends = F.expr("concat(transform(filter(arrays_zip(spans, concat(array(-1L), reach)), z -> z.spans is not null and z.spans.start > z.`1`), z -> z.spans.start), array(cast(length(text) as long)))")
    found = found.withColumns({"begins": begins, "ends": ends})
    chunks = f"regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0)"
    part = f"substring(x, cast(greatest(b - (b div {CHUNK} + i) * {CHUNK}, 0L) as int) + 1, cast(least(e - (b div {CHUNK} + i) * {CHUNK}, {CHUNK}L) - greatest(b - (b div {CHUNK} + i) * {CHUNK}, 0L) as int))"
    piece = f"if(e <= b, '', array_join(transform(slice(c, cast(b div {CHUNK} as int) + 1, cast((e - 1) div {CHUNK} - b div {CHUNK} as int) + 1), (x, i) -> {part}), ''))"
    joined = F.expr(_let(chunks, "c", f"array_join(zip_with(begins, ends, (b, e) -> {piece}), '{mask}')"))
    clean = F.when(F.size("spans") > 0, joined).otherwise(F.col("text"))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
