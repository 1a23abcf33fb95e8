"""Secret scans: patterns for known shapes, sliding-window entropy for the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the three known shapes look like.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: A candidate is a whole run of these characters; a secret of a known shape without a keyword lies in one.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Window in characters, and the least entropy in bits of a window of each class: of hexadecimal digits only, of letters only, of others.
WINDOW, HEX_BITS, LETTER_BITS, MIXED_BITS = 20, 3.0, 4.0, 3.7
#: Values that are folded at a time.
FOLDED = 256
#: Candidates that are known to be harmless: UUIDs, placeholders within a word, words joined by signs, numbers. A placeholder that
#: is a word by itself, as in dummy/<key>, says nothing about the rest.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    r"|(?<=[A-Za-z0-9])(?i:example|placeholder|changeme|dummy)|(?i:example|placeholder|changeme|dummy)(?=[A-Za-z0-9])"
    r"|(?i:x{6}|0123456789abcdef|abcdefghijklmnop)"
    r"|^(?=[A-Za-z]*[/_+-])[A-Za-z/_+-]+$"
    r"|^[0-9/_+-]+$"
)

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the longs what `op` makes of those before it, from 0: within blocks of values, then over the blocks.

    A fold that gathers an array copies it with each step; in blocks that stays
    in proportion to the number of values.
    """

    def fold(x: Column) -> Column:
        empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("got"))
        return F.aggregate(x, empty, lambda s, y: F.struct(op(s["at"], y).alias("at"), F.concat(s["got"], F.array(s["at"])).alias("got")))

    def of(v: Column) -> Column:
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / FOLDED).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(v, k * FOLDED + 1, FOLDED)))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, fold(F.transform(b, lambda x: x["at"]))["got"], lambda x, first: F.transform(x["got"], lambda y: op(first, y)))))

    return _let(values, of)


def _spans(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Spans of the matches from left to right with what matched: array<struct<start, rank, kind, end, found>>.

    The pieces between the matches give the places: in code points, end exclusive.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found")), lambda x: x["found"].isNotNull())
    sized = F.transform(
        pieces, lambda x: F.struct(F.length(x["gap"]).cast("bigint").alias("gap"), F.length(x["found"]).cast("bigint").alias("n"), x["found"].alias("found"))
    )
    placed = lambda x, at: F.struct(
        (at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("end"), x["found"].alias("found")
    )
    return _let(sized, lambda s: F.zip_with(s, _before(F.transform(s, lambda x: x["gap"] + x["n"]), lambda a, b: a + b), placed))


#: c * log2(c), 0 for 0
_F = "if({0} > 1, {0} * log2({0}), 0D)"


def _entropy_sql(codes: str, bits: str) -> str:
    """First and last window, as struct<a, b> of the windows' last places, with an entropy of at least `bits`; null if none.

    Sum of c * log2(c) over the counts c of a window's characters is kept as
    the window slides: one count goes up, one down, and only their terms change.
    """
    step_in = f"{_F.format('(s.n[x.i] + 1)')} - {_F.format('s.n[x.i]')}"
    n_out = "(s.n[x.o] + if(x.i = x.o, 1, 0))"
    step_out = f"if(x.o is null, 0D, {_F.format(f'({n_out} - 1)')} - {_F.format(n_out)})"
    total = f"(s.t + {step_in} + {step_out})"
    high = f"x.k >= {WINDOW - 1} and log2({WINDOW}) - {total} / {WINDOW} >= {bits}"
    return (
        f"aggregate(transform({codes}, (y, k) -> struct(k as k, y as i, get({codes}, k - {WINDOW}) as o)), "
        "named_struct('n', array_repeat(0, 128), 't', 0D, 'a', cast(null as int), 'b', cast(null as int)), "
        "(s, x) -> named_struct("
        "'n', transform(s.n, (v, j) -> v + if(j = x.i, 1, 0) - if(j <=> x.o, 1, 0)), "
        f"'t', {total}, "
        f"'a', if(s.a is null and {high}, x.k, s.a), 'b', if({high}, x.k, s.b)), "
        "s -> if(s.a is null, null, named_struct('a', s.a, 'b', s.b)))"
    )


def with_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with base and spans, each array<struct<start, rank, kind, end>> by start, then kind.

    base holds the spans of the kinds assign, access and hex; spans has these
    and, for windows of high entropy in candidates that are not allowed,
    hex_entropy, mixed_entropy and letter_entropy: from the first such window's start to the
    last one's end. A null or empty text has none. Columns of `docs` called
    base or spans are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lowered = F.lower(text)
    keyed = lowered.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        keyed = keyed | lowered.contains(k)
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,found:string>>")
    has = text.rlike(CANDIDATE)
    assign = F.filter(_spans(text, ASSIGN, "assign", 0), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 6)
    out = (
        docs.drop("base", "spans")
        .withColumn("_base", F.concat(
            F.when(keyed, assign).otherwise(none),
            F.when(has & text.contains("AKIA"), _spans(text, ACCESS, "access", 1)).otherwise(none),
            F.when(has, _spans(text, HEX, "hex", 2)).otherwise(none)))
        .withColumn("_cand", F.filter(F.when(has, _spans(text, CANDIDATE, "", 3)).otherwise(none), lambda x: ~x["found"].rlike(ALLOWED)))
        .withColumn("_cand", F.expr(
            "transform(_cand, c -> named_struct('start', c.start, 'class', case when c.found rlike '^[0-9a-fA-F]+$' then 3 when c.found rlike '^[A-Za-z]+$' then 5 else 4 end, "
            "'codes', transform(split(c.found, ''), z -> ascii(z))))"))
        .withColumn("_high", F.expr(
            "transform(_cand, c -> named_struct('start', c.start, 'class', c.class, 'w', "
            + _entropy_sql("c.codes", f"case c.class when 3 then {HEX_BITS}D when 5 then {LETTER_BITS}D else {MIXED_BITS}D end") + "))"))
    )
    plain = "transform(_base, x -> named_struct('start', x.start, 'rank', x.rank, 'kind', x.kind, 'end', x.end))"
    high = (
        "transform(filter(_high, x -> x.w is not null), x -> named_struct("
        f"'start', x.start + x.w.a - {WINDOW - 1}, 'rank', x.class, 'kind', case x.class when 3 then 'hex_entropy' when 5 then 'letter_entropy' else 'mixed_entropy' end, "
        "'end', x.start + x.w.b + 1))"
    )
    return (
        out.withColumn("base", F.expr(f"array_sort(cast({plain} as array<{SPAN}>))"))
        .withColumn("spans", F.expr(f"array_sort(concat(base, cast({high} as array<{SPAN}>)))"))
        .drop("_base", "_cand", "_high")
    )


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each run of overlapping spans of text replaced by `mark`; needs the columns base and spans, which go."""
    ends = _before(F.transform("spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    # a run begins where all spans before have ended; `at` is where the one before ended
    runs = F.filter(F.zip_with("spans", ends, lambda x, at: F.struct(x["start"].alias("start"), at.alias("at"))), lambda x: x["start"] >= x["at"])
    part = lambda text, a, z: F.substring(text, (a + 1).cast("int"), (z - a).cast("int"))

    def masked(block: Column) -> Column:
        """The texts before the runs of a block, each followed by the mark; places within the block's text, so that a long text is read once a block."""
        whole = _let(part(F.col("text"), block[0]["at"], F.element_at(block, -1)["start"]), lambda t: F.array_join(
            F.transform(block, lambda r: F.concat(part(t, r["at"] - block[0]["at"], r["start"] - block[0]["at"]), F.lit(mark))), ""))
        return whole

    last = F.floor((F.size("_r") - 1) / FOLDED).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: _let(F.slice("_r", k * FOLDED + 1, FOLDED), masked))
    rest = F.expr("substring(text, cast(array_max(transform(spans, x -> x.end)) as int) + 1)")
    return (
        docs.withColumn("_r", runs)
        .withColumn("text", F.when(F.size("spans") > 0, F.concat(F.array_join(blocks, ""), rest)).otherwise(F.col("text")))
        .drop("spans", "base", "_r")
    )
