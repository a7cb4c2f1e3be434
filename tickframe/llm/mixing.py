"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is wanted ``target / source_size`` times. The whole part of that
number is taken as it is; the fraction is a probability, held as words: ``mass`` out of
``size``. Rounding moves words between a document and its partner at random until one of the
two holds none or all of what it can (Deville and Tille 1998), so a source's sum of words is
kept in every step and each document's probability in expectation.

Documents fall into small chunks by hash. In a chunk the largest document goes first and its
partner is the pool of all smaller ones, whose probabilities move together by one affine map;
so what a chunk leaves fractional is one document, a small one as a rule. These residuals are
put together chunk by chunk and rounded again, in as many levels as it takes until a source
has one chunk. Its last residual is drawn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.neardup import written
from tickframe.operators.splits import dense_row_number
from tickframe.session import broadcast_if_small

#: Sources weigh these, repeating, in the order of their names.
WEIGHTS = (1.0, 2.0, 3.0)
#: No document is taken more often than this.
MOST = 3
#: Documents of a chunk on average, and residuals of a chunk of the next level at most.
CHUNK = 64
#: Repeated rows beyond this many are counted out in blocks of so many.
REPEATS = 1024
_UNIT = 1 << 53


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(_UNIT)) / F.lit(float(_UNIT))


def source_targets(
    sizes: DataFrame, share: float = 1.0, weights: Sequence[float] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """Per source its number in name order (null last), rows, size, weight and target.

    ``sizes`` has ``source`` and ``size``. Targets are the share of all sizes split by
    weight; what lies above ``most`` times a source's size is split again among the others,
    until none is above.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("filled")
    )
    # one row per source, numbered by range partitions, as there may be many
    ranked = dense_row_number(per.withColumn("nameless", F.col("source").isNull()), ["nameless", "source"])
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weight = F.get(cycle, ((F.col("rn") - 1) % len(weights)).cast("int"))
    per = written(ranked.select(F.col("rn").alias("src"), "source", "source_size", "filled", weight.alias("weight")), "sources")
    cap = (F.col("source_size") * most).cast("double")
    total = share * float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # the set of capped sources only grows, so this ends
        above = F.lit(capped >= 0) & (F.col("weight") * F.lit(level) > cap)
        found = per.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, F.col("source_size") * most)).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
        ).first()
        if found.n == capped:
            break
        capped, level = found.n, max(total - (found.held or 0), 0.0) / found.open if found.open else level
    return per.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def _copies(rows: DataFrame) -> DataFrame:
    """Rows numbered apart from rows equal to them: counted first, then told off by count."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    few = counted.where(F.col("times") <= REPEATS).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {REPEATS}"))
    many = counted.where(F.col("times") > REPEATS).withColumn("block", F.explode(blocks))
    many = many.repartition(F.xxhash64(*many.columns))
    first = F.col("block") * REPEATS + 1
    told = F.sequence(first, F.least("times", first + (REPEATS - 1)))
    return few.union(many.withColumn("copy", F.explode(told)).drop("block")).drop("times")


def _round(units: DataFrame, level: int, seed: int) -> DataFrame:
    """Round every chunk of units ``(src, chunk, size, key, id, copy, mass)``.

    Back come ``src, chunk`` and ``done``: the units with ``bit`` 0 or 1, or with a null bit
    and their mass, which at most one unit of a chunk has.
    """
    unit = F.struct((-F.col("size")).alias("minus"), "key", "id", "copy", "size", "mass")
    chunks = units.groupBy("src", "chunk").agg(F.sort_array(F.collect_list(unit)).alias("units"))

    def within(low, value: Column, high) -> Column:
        return F.greatest(F.lit(low), F.least(value, high))

    def once(value: Column, use) -> Column:
        """A value named once, so that it is computed once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def step(state: Column, u: Column) -> Column:
        # the pool: units still to come; each holds a * (its mass) + b * (its size) words by now
        own = F.struct(
            within(0.0, state["a"] * u["mass"] + state["b"] * u["size"], u["size"].cast("double")).alias("x"),
            (state["mass"] - u["mass"]).alias("mass"),
            (state["size"] - u["size"]).alias("size"),
        )
        own = once(own, lambda o: o.withField("m", within(0.0, state["a"] * o["mass"] + state["b"] * o["size"], o["size"].cast("double"))))

        def chosen(o: Column) -> Column:
            free = o["size"] - o["m"]
            up, down = F.least(u["size"] - o["x"], o["m"]), F.least(o["x"], free)
            gets = _draw(u["key"], F.lit(level), F.lit(seed)) * (up + down) < down
            # the pool keeps this share of its words, or of its room
            kept = F.when(gets, F.try_divide(o["m"] - up, o["m"])).otherwise(F.try_divide(free - down, free))
            return o.withField("gets", gets).withField("kept", F.coalesce(kept, F.lit(1.0))).withField("free", free)

        def settled(o: Column) -> Column:
            integral = (o["x"] <= 0) | (o["x"] >= u["size"])
            bit = (
                F.when(integral, (o["x"] > 0).cast("int"))
                .when(o["gets"] & (u["size"] - o["x"] <= o["m"]), 1)
                .when(~o["gets"] & (o["x"] <= o["free"]), 0)
            )
            rest = F.when(o["gets"], o["x"] + o["m"]).otherwise(o["x"] - o["free"])
            kept = F.when(integral, 1.0).otherwise(o["kept"])
            gained = F.when(integral | o["gets"], 0.0).otherwise(1 - o["kept"])
            mark = F.struct(u["key"].alias("key"), u["id"].alias("id"), u["copy"].alias("copy"), u["size"].alias("size"), rest.alias("mass"), bit.alias("bit"))
            return F.struct(
                (state["a"] * kept).alias("a"),
                (state["b"] * kept + gained).alias("b"),
                o["mass"].alias("mass"),
                o["size"].alias("size"),
                F.array_append(state["done"], mark).alias("done"),
            )

        return once(once(own, chosen), settled)

    kind = units.schema["id"].dataType.simpleString()
    done = f"array<struct<key:bigint,id:{kind},copy:bigint,size:bigint,mass:double,bit:int>>"
    start = F.struct(
        F.lit(1.0).alias("a"),
        F.lit(0.0).alias("b"),
        F.aggregate("units", F.lit(0.0), lambda s, u: s + u["mass"]).alias("mass"),
        F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + u["size"]).alias("size"),
        F.array().cast(done).alias("done"),
    )
    return chunks.select("src", "chunk", F.aggregate("units", start, step)["done"].alias("done"))


def mix_sources(
    docs: DataFrame,
    size: Column,
    share: float = 1.0,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    seed: int = 13,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``id_col, source_col, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``size`` is a whole number (null counts as 0), ``share`` the part of all sizes that the
    mix takes, ``copies`` how often it takes the document (0 to ``most``) and ``taken`` is
    copies times size. A source's sum of ``taken`` differs from its target by less than one
    document, as a rule a small one. The same rows give the same mix however they are
    partitioned. Null sources are one source, the last; null ids are ids; repeated rows are
    rounded apart. Documents of size 0 are never taken. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size")
    )
    rows = written(rows, "sizes")
    sources = written(source_targets(rows, share, weights, most), "targets")
    wanted = F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), F.lit(float(most)))
    sources = sources.withColumn("whole", F.floor(wanted)).withColumn("part", wanted - F.col("whole"))
    sources = sources.withColumn("chunks", F.greatest(F.ceil(F.col("filled") / CHUNK), F.lit(1)))
    named = broadcast_if_small(sources.select(F.col("source").alias("name"), "src", "whole", "part", "chunks"))
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("name")))
    split = (F.col("part") > 0) & (F.col("size") > 0)
    sure = placed.where(~split).select("src", "id", "size", "whole")

    units = _copies(placed.where(split).select("src", "id", "size", "part", "chunks"))
    units = units.withColumn("key", F.xxhash64("src", "id", "size", "copy", F.lit(seed)))
    units = units.select(
        "src", F.pmod("key", "chunks").alias("chunk"), "size", "key", "id", "copy", (F.col("part") * F.col("size")).alias("mass")
    )
    chunks, level, bits = sources.agg(F.max("chunks")).first()[0] or 1, 0, None
    while True:
        done = written(_round(units, level, seed), "rounded")
        marks = done.select("src", "chunk", F.inline("done"))
        part = marks.where(F.col("bit").isNotNull()).select("src", "id", "size", "bit")
        bits = part if bits is None else bits.union(part)
        left = marks.where(F.col("bit").isNull())
        if chunks <= 1:
            break
        units = left.withColumn("chunk", F.expr(f"chunk div {CHUNK}")).drop("bit")
        chunks, level = -(-chunks // CHUNK), level + 1
    last = _draw("key", F.lit(-1), F.lit(seed)) * F.col("size") < F.col("mass")
    bits = bits.union(left.select("src", "id", "size", last.cast("int").alias("bit")))

    named = broadcast_if_small(sources.select("src", "source", "source_size", "target", "whole"))
    rounded = bits.join(named, "src").withColumn("copies", F.col("whole") + F.col("bit"))
    kept = sure.join(named.drop("whole"), "src").withColumn("copies", F.col("whole"))
    out = ["id", "source", "size", "source_size", "target", "copies"]
    both = rounded.select(*out).union(kept.select(*out))
    return both.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix_words(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """:func:`mix_sources` where a document's size is its words, none for a null text."""
    return mix_sources(docs, F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), **options)
