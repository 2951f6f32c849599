"""Items that appear together: an incrementally kept, persistent table of pair counts.

The table keeps these relations in hash buckets below one folder of the shared file system:

* ``baskets``   the items of every basket, with what they were before the generation that changed them last;
* ``marginals`` number of baskets per group and item, under the item's code; without an item, of non-empty baskets per group;
* ``pairs``     number of baskets per unordered pair of codes;
* ``scores``    the association scores of all pairs seen ``min_count`` times or more.

``apply`` takes changed baskets. Each emits its old pairs with sign -1 and its new pairs with +1; the deltas are summed
map-side and merged into the buckets they touch; untouched buckets stay as files of an older generation. ``refresh``
recomputes the scores of the groups that changed since the last refresh (a group's total enters all its scores) and
leaves the others. A manifest, written after everything else, names the files of each bucket: a table opened again, in
this or another session, goes on where the last complete change ended, and a change that broke off leaves no trace.

A code is a 64-bit hash of group and item. Should two items of the table share one, the marginals show it and all
counts are built anew from the baskets under another seed, so counts are exact.

Buckets are cut by the hash that an aggregate's exchange uses, so a task of that exchange writes to few buckets, each
bucket is written by many tasks, and none is one task's work; their number follows the pairs counted, and grows with
them. Pairs are listed inside the JVM. A basket of more than ``WIDE`` items is cut into blocks of ``BLOCK`` items, one
row each; block pairs are joined on (basket, block, block), so that a giant basket never is one row's or one task's work.

Defined results: a basket is the union of all rows ever given for its id, over all changes, unless ``replace`` is asked
for: then the rows of this change, united, become its content. Null items, null baskets and null arrays count nothing; a
repeated item counts once in a basket; an empty array that replaces removes the basket; null group columns form a group
of their own; extra columns of any name are ignored; an empty change leaves the table as it is.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BLOCK = 64
#: From this many items on, a basket is spread over tasks.
WIDE = 256
#: Pairs counted in a bucket, about.
FULL = 4_000_000
#: Fewest buckets.
FEW = 4


def basket_pairs(baskets: DataFrame, keep: list[str], ids: list[str], codes: str = "_codes") -> DataFrame:
    """``keep``, ``_x`` < ``_y`` for every basket and unordered pair of its sorted distinct codes. ``ids`` tell baskets apart."""
    rows = baskets.filter(F.size(codes) >= 2)
    own = "flatten(transform({0}, (a, i) -> transform(slice({0}, i + 2, size({0})), b -> struct(a as _x, b as _y))))"
    small = rows.filter(F.size(codes) <= WIDE).select(*keep, F.expr(f"inline({own.format(codes)})"))
    cut = f"transform(sequence(0, cast((size({codes}) - 1) / {BLOCK} as int)), b -> slice({codes}, b * {BLOCK} + 1, {BLOCK}))"
    wide = rows.filter(F.size(codes) > WIDE)
    wide = wide.select(*keep, F.xxhash64(*ids).alias("_id"), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.ceil(F.size(codes) / BLOCK).cast("int").alias("_m"), F.posexplode(F.expr(cut)).alias("_i", "_block"))
    on = ["_id", *[f"_id{i}" for i in range(len(ids))]]
    left = wide.select(*keep, *on, F.col("_block").alias("x"), F.col("_i").alias("_p"), F.explode(F.sequence("_i", F.col("_m") - 1)).alias("_q"))
    right = wide.select(*[F.col(c).alias(f"r{c}") for c in on], F.col("_block").alias("y"), F.col("_i").alias("_s"), F.explode(F.sequence(F.lit(0), F.col("_i"))).alias("_t"))
    same = (F.col("_p") == F.col("_t")) & (F.col("_q") == F.col("_s"))
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"r{c}"))
    both = f"if(_p = _q, {own.format('x')}, flatten(transform(x, a -> transform(y, b -> struct(a as _x, b as _y)))))"
    return small.unionByName(left.join(right, same).select(*keep, F.expr(f"inline({both})")))


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


class PairTable:
    """Persistent pair counts below ``path``, opened again if they are there; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, group: dict[str, str], item_type: str = "string", min_count: int = 1, buckets: int | None = None):
        self.spark, self.path, self.group, self.item_type = spark, path, list(group), item_type
        kept = self._manifest()
        self.generation = kept.get("generation", 0)
        self.at = {n: {int(b): g for b, g in kept.get("at", {}).get(n, {}).items()} for n in ("baskets", "marginals", "pairs", "scores")}
        self.fixed, self.buckets, self.seed = buckets, kept.get("buckets", buckets or FEW), kept.get("seed", 0)
        self.score_buckets = kept.get("score_buckets", 0)
        self.counted, self.scored, self.min_count = kept.get("counted", 0), kept.get("scored", 0), kept.get("min_count", min_count)
        key = "".join(f"`{k}` {t}, " for k, t in group.items())
        self.schema = {
            "baskets": f"{key}_basket string, _items array<{item_type}>, _was array<{item_type}>, _changed int",
            "marginals": f"_code bigint, {key}_a {item_type}, _n bigint, _clash boolean",
            "pairs": "_x bigint, _y bigint, _n bigint",
            "scores": f"{key}item_a {item_type}, item_b {item_type}, n bigint, n_a bigint, n_b bigint, n_ab bigint, lift double, confidence double",
        }
        self.keys = {"baskets": [*self.group, "_basket"], "marginals": ["_code"], "pairs": ["_x", "_y"], "scores": self.group}

    # -- files

    def _manifest(self) -> dict:
        # a table that is new gets an empty manifest of generation 0, so that there is one to read
        self.spark.range(0).select(F.lit("").alias("value")).write.mode("ignore").text(f"{self.path}/manifest/gen=0")
        last = self.spark.read.schema("value string, gen int").text(f"{self.path}/manifest").orderBy(F.desc("gen")).first()
        return json.loads(last["value"]) if last else {}

    def _commit(self) -> None:
        kept = {"generation": self.generation, "buckets": self.buckets, "seed": self.seed, "counted": self.counted, "scored": self.scored, "score_buckets": self.score_buckets, "min_count": self.min_count, "at": self.at}
        self.spark.range(1).select(F.lit(json.dumps(kept)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/gen={self.generation}")

    def read(self, name: str, only: set[int] | None = None) -> DataFrame:
        """The current rows of a relation, of some buckets or of all."""
        paths = [f"{self.path}/{name}/gen={g}/_bucket={b}" for b, g in sorted(self.at[name].items()) if only is None or b in only]
        schema = self.schema[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.hash(F.lit(0), *self.keys[name]) if not self.keys[name] else F.hash(*self.keys[name]), F.lit(self.buckets)).cast("int")

    def _store(self, name: str, rows: DataFrame, at: str) -> set[int]:
        """Write rows by bucket; the buckets written."""
        rows.withColumn("_bucket", self._bucket(name)).write.partitionBy("_bucket").mode("overwrite").parquet(at)
        return {int(m[1]) for f in self.spark.read.schema(self.schema[name]).parquet(at).inputFiles() if (m := re.search(r"/_bucket=(\d+)/", f))}

    def _replace(self, name: str, rows: DataFrame, buckets: set[int] | None) -> None:
        """Make rows the content of the buckets; None: of all, whatever their number was."""
        have = self._store(name, rows, f"{self.path}/{name}/gen={self.generation}")
        if buckets is None:
            self.at[name] = {}
        for b in have | (buckets or set()):
            if b in have:
                self.at[name][b] = self.generation
            else:
                self.at[name].pop(b, None)

    # -- changes

    def _given(self, changed: DataFrame, basket: str, items: str) -> DataFrame:
        """One row per basket of a change: its sorted distinct items."""
        return (
            changed.select(*self.group, F.col(basket).cast("string").alias("_basket"), F.array_compact(F.coalesce(F.col(items), F.array())).alias("_items"))
            .filter(F.col("_basket").isNotNull())
            .groupBy(*self.group, "_basket")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
        )

    def apply(self, changed: DataFrame, basket: str, items: str, replace: bool = False) -> None:
        """Take changed baskets: group columns, ``basket`` id and ``items`` array."""
        self.generation += 1
        gen, g = self.generation, self.group
        given = self._given(changed, basket, items).withColumns({"_was": F.lit(None).cast(self._array()), "_changed": F.lit(gen)})
        size = F.size("_items").cast("bigint")
        if not self.at["baskets"]:
            # the rows given are the new state as they stand
            seen = Observation()
            at = f"{self.path}/incoming/gen={gen}"
            given = given.filter(F.size("_items") > 0)
            self._replace("baskets", given.observe(seen, F.sum(size * (size - 1) / 2).alias("pairs")), None)
            if self._fit(int(seen.get["pairs"] or 0), first=True):
                # more buckets than the fewest: once more by those
                given = self.read("baskets")
                given.write.mode("overwrite").parquet(at)
                self._replace("baskets", self.spark.read.schema(self.schema["baskets"]).parquet(at), None)
            hit = set(self.at["baskets"])
        else:
            at = f"{self.path}/incoming/gen={gen}"
            seen = Observation()
            hit = self._store("baskets", given.observe(seen, F.sum(size * (size - 1) / 2).alias("pairs")), at)
            given = self.spark.read.schema(self.schema["baskets"]).parquet(at)
            rows = seen.get["pairs"] or 0
            # so many pairs are in every bucket, and which ones they touch need not be found out
            if self._fit(self.counted + int(rows)) or rows >= 16 * self.buckets:
                hit = None
            new = given.select(*[F.col(c).alias(f"n{i}") for i, c in enumerate([*g, "_basket"])], F.col("_items").alias("_new"))
            old = self.read("baskets", hit)
            both = old.join(new, _same([*g, "_basket"], [f"n{i}" for i in range(len(g) + 1)]), "full_outer")
            after = F.col("_new") if replace else F.array_sort(F.array_union(F.coalesce("_items", F.array().cast(self._array())), "_new"))
            after = F.when(F.col("_new").isNotNull(), after).otherwise(F.col("_items"))
            moved = F.col("_new").isNotNull() & ~after.eqNullSafe(F.col("_items"))
            here = F.col("_changed").isNotNull()
            both = both.select(
                *[F.when(here, F.col(c)).otherwise(F.col(f"n{i}")).alias(c) for i, c in enumerate([*g, "_basket"])],
                after.alias("_items"), F.when(moved, F.col("_items")).alias("_was"), F.when(moved, F.lit(gen)).otherwise(F.col("_changed")).alias("_changed"),
            )
            # a basket that was emptied stays until its pairs are taken back and its group's scores are made anew
            self._replace("baskets", both.filter((F.size("_items") > 0) | (F.col("_changed") > self.scored)), hit)
        signed = self._signed(self.read("baskets", hit).filter(F.col("_changed") == gen))
        self._count(signed, everywhere=hit is None)
        self._commit()

    def _array(self) -> str:
        return f"array<{self.item_type}>"

    def _fit(self, counted: int, first: bool = False) -> bool:
        """Take the number of pairs counted; whether the number of buckets changes for it."""
        self.counted = counted
        want = FEW
        while want * FULL < counted:
            want *= 2
        if self.fixed or (not first and want < 4 * self.buckets):
            return False
        changes, self.buckets = want != self.buckets, want
        return changes

    def _signed(self, changed: DataFrame) -> DataFrame:
        """Old content with sign -1, new content with +1, non-empty ones, with their codes."""
        keep = [*self.group, "_basket"]
        both = changed.select(*keep, F.explode(F.array(F.struct(F.lit(-1).alias("_sign"), F.col("_was").alias("_items")), F.struct(F.lit(1).alias("_sign"), F.col("_items").alias("_items")))).alias("v"))
        both = both.select(*keep, "v._sign", "v._items").filter(F.size("_items") > 0)
        tell = [x for c in self.group for x in (F.isnull(c), F.col(c))]
        return both.withColumn("_codes", F.array_sort(F.transform("_items", lambda x: F.xxhash64(F.lit(self.seed), *tell, x))))

    def _count(self, signed: DataFrame, everywhere: bool) -> None:
        """Merge the deltas of signed baskets into the counts, in the buckets they touch or in all."""
        g, gen, seen = self.group, self.generation, Observation()
        tell = [x for c in g for x in (F.isnull(c), F.col(c))]
        one = signed.select(*g, "_sign", F.explode(F.concat(F.array(F.lit(None).cast(self.item_type)), "_items")).alias("_a"))
        deltas = {
            "marginals": one.groupBy(*g, "_a").agg(F.sum("_sign").alias("_n")).select(F.xxhash64(F.lit(self.seed), *tell, F.col("_a")).alias("_code"), *g, "_a", "_n", F.lit(False).alias("_clash")),
            "pairs": basket_pairs(signed.filter(F.size("_codes") > 1), ["_sign"], [*g, "_basket", "_sign"]).groupBy("_x", "_y").agg(F.sum("_sign").alias("_n")),
        }
        for name, delta in deltas.items():
            hit: set[int] | None = None
            if self.at[name]:
                if not everywhere:
                    at = f"{self.path}/delta-{name}/gen={gen}"
                    hit = self._store(name, delta.filter("_n <> 0"), at)
                    delta = self.spark.read.schema(self.schema[name]).parquet(at).drop("_bucket")
                delta = delta.unionByName(self.read(name, hit))
                if name == "pairs":
                    delta = delta.groupBy("_x", "_y").agg(F.sum("_n").alias("_n"))
            if name == "marginals":
                # rows of one code that differ in group or item are two items
                who = F.struct(*g, "_a")
                delta = delta.groupBy("_code").agg(F.min(who).alias("w"), F.sum("_n").alias("_n"), (F.count_if("_clash") + F.when(F.min(who) != F.max(who), 1).otherwise(0) > 0).alias("_clash"))
                delta = delta.select("_code", "w.*", "_n", "_clash")
            delta = delta.filter("_n <> 0" if name == "pairs" else "_n <> 0 or _clash")
            if name == "marginals":
                delta = delta.observe(seen, F.count_if("_clash").alias("clashes"))
            self._replace(name, delta, hit)
        if seen.get["clashes"]:
            self.seed += 1
            for name in deltas:
                self.at[name] = {}
            everything = self.read("baskets").withColumn("_was", F.lit(None).cast(self._array()))
            self._count(self._signed(everything), everywhere=True)

    # -- scores

    def _touched(self) -> DataFrame:
        """Groups that changed since the scores were made."""
        rows = self.read("baskets").filter(F.col("_changed") > self.scored)
        names = self.group or [F.lit(0)]
        return rows.select(*[F.col(c).alias(f"t{i}") if isinstance(c, str) else c.alias("t0") for i, c in enumerate(names)]).distinct()

    def _scored(self, touched: DataFrame | None, min_count: int) -> DataFrame:
        g = self.group
        here = [f"t{i}" for i in range(len(g))]
        pairs = self.read("pairs").filter(F.col("_n") >= min_count)
        m = self.read("marginals")
        if touched is not None and g:
            m = m.join(touched, _same(g, here), "left_semi")
        left = m.filter("_a is not null").select(F.col("_code").alias("_x"), *g, F.col("_a").alias("l"), F.col("_n").alias("nl"))
        right = self.read("marginals").filter("_a is not null").select(F.col("_code").alias("_y"), F.col("_a").alias("r"), F.col("_n").alias("nr"))
        total = m.filter("_a is null").select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(g)], F.col("_n").alias("n"))
        rows = pairs.join(left, "_x").join(right, "_y").join(total, _same(g, [f"g{i}" for i in range(len(g))]))
        swap = F.col("l") > F.col("r")
        rows = rows.select(
            *g, F.least("l", "r").alias("item_a"), F.greatest("l", "r").alias("item_b"), "n",
            F.when(swap, F.col("nr")).otherwise(F.col("nl")).alias("n_a"), F.when(swap, F.col("nl")).otherwise(F.col("nr")).alias("n_b"), F.col("_n").alias("n_ab"),
        )
        return rows.withColumns({"lift": F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")), "confidence": F.col("n_ab") / F.col("n_a")})

    def refresh(self) -> None:
        """Recompute the scores of the groups that changed since the last refresh; the others stay as they are."""
        if self.scored == self.generation:
            return
        first = not self.scored
        touched = None if first else self._touched()
        new = self._scored(touched, self.min_count)
        hit: set[int] | None = None
        if not first:
            names = [f"t{i}" for i in range(len(self.group))]
            own = F.pmod(F.hash(*names) if names else F.hash(F.lit(0)), F.lit(self.buckets)).cast("int")
            hit = {r[0] for r in touched.select(own.alias("b")).distinct().collect()} if self.score_buckets == self.buckets else None
            new = self.read("scores", hit).join(touched, _same(self.group, names) if names else F.lit(True), "left_anti").unionByName(new)
        # a group's scores go to several files of its bucket, whatever its size
        new = new.repartition(self._bucket("scores"), F.pmod(F.hash("item_a"), F.lit(8)))
        self.scored = self.generation
        self._replace("scores", new, hit)
        self.score_buckets = self.buckets
        self._commit()

    def scores(self, affected: bool = False) -> DataFrame:
        """Group columns, ``item_a`` < ``item_b``, ``n``, ``n_a``, ``n_b``, ``n_ab``, ``lift``, ``confidence`` (of b given a).

        The stored scores after ``refresh``; ``affected``: those of groups changed since then, as they are now.
        """
        return self._scored(self._touched(), self.min_count) if affected else self.read("scores")
