"""Stored index of file names: prefix search, autocompletion and the shape of the name tree from sorted parts of a table.

A row's key is the lower-cased name, a zero character and the path, so names are sorted case aside, equal names by path, and no key occurs twice. Every part of the table holds the keys
from its bound to the next one's; its files are sorted, so a search reads the parts that overlap the prefix and in these the row groups whose smallest and largest keys do. The
first names with a prefix are the first rows of that range: no lists of suggestions are stored that a change would have to mend.

A change rewrites the parts of its files. A part of over twice `part_rows` rows is split at bounds from a sample of its keys, also on the first load, when all rows are in one part; bounds are on
whole keys, so very many files of one name are split as well. There are at most some MOST_PARTS parts: beyond, they grow with the table.

Null and empty paths have no name and are left out; a path that is added twice is there once; removing what is not there changes nothing.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, suffix
from ..session import stored, unstored
from ..sources.ledger import Change, Ledger, Snapshot

PART_ROWS, MOST_PARTS, SAMPLED = 200_000, 4_096, 50
NAMES = "k string, filename string, file_path string, part string"


def keyed(paths: DataFrame) -> DataFrame:
    """(k, filename, file_path) of (file_path), each once."""
    name = basename(F.col("file_path"))
    return paths.filter(name != "").select(F.concat(F.lower(name), F.lit("\0"), "file_path").alias("k"), name.alias("filename"), "file_path").dropDuplicates(["k"])


def common_letters(a: Column, b: Column) -> Column:
    """How many letters two names begin with alike."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(differs == 0, F.length(a)).otherwise(differs - 1)


@dataclass
class NameIndex:
    ledger: Ledger
    name: str = "names"
    part_rows: int = PART_ROWS

    def cuts(self, snapshot: Snapshot) -> list[tuple[str, str]]:
        """(bound, part) by bound; the first bound is below every key."""
        return [tuple(c) for c in snapshot.properties.get(f"{self.name}_cuts", [["", "0"]])]

    def parted(self, rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
        """rows with their part: that of the last bound not above its key, found by bisection; the bounds (some MOST_PARTS at most) go along with every task."""
        rows = rows.drop("part")
        shared = rows.sparkSession.sparkContext.broadcast(([b.encode() for b, _ in cuts], [p for _, p in cuts]))
        at = rows.columns.index("k")

        def run(batches):
            bounds, parts = shared.value
            for b in batches:
                found = [parts[bisect_right(bounds, k.encode()) - 1] for k in b.column(at).to_pylist()]  # by bytes, as Spark compares
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "part"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("part", T.StringType())]))

    def update(self, change: Change, added: DataFrame, removed: DataFrame) -> None:
        """Files (file_path) that are new and files that are gone."""
        cuts = self.cuts(change.base)
        both = keyed(added).withColumn("gone", F.lit(False)).unionByName(keyed(removed).withColumn("gone", F.lit(True)))
        told = stored(self.parted(both, cuts), "names")
        touched = [r["part"] for r in told.select("part").distinct().collect()]  # at most all parts
        if touched:
            old = change.table(self.name, NAMES, touched).join(told.filter("gone").select("k"), "k", "left_anti")
            rows = stored(old.unionByName(told.filter("not gone").drop("gone")).dropDuplicates(["k"]), "names")
            cuts = self.split(change, cuts, rows)
            change.replace_parts(self.name, self.parted(rows, cuts), "part", touched, ("k",))
            unstored(rows)
        unstored(told)

    def split(self, change: Change, cuts: list[tuple[str, str]], rows: DataFrame) -> list[tuple[str, str]]:
        """The bounds after parts that have become too large are split."""
        sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # at most all parts
        total = sum(sizes.values()) + sum(e["rows"] for p, entries in change.base.parts(self.name).items() if p not in sizes for e in entries)
        most = max(self.part_rows, total // MOST_PARTS)
        wanted = {p: -(-n // most) for p, n in sizes.items() if n > 2 * most}
        if not wanted:
            return cuts
        # A share of each part's keys, by the hash of the key: some SAMPLED for each part that is wanted.
        share = F.from_json(F.lit(json.dumps({p: min(1.0, SAMPLED * w / sizes[p]) for p, w in wanted.items()})), "map<string,double>")
        drawn = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(1_000_000)) < F.try_element_at(share, F.col("part")) * 1_000_000
        sample: dict[str, list[str]] = {}
        for r in rows.filter(drawn).select("part", "k").collect():
            sample.setdefault(r["part"], []).append(r["k"])
        new = set()
        for p, keys in sample.items():
            keys.sort()
            new.update(keys[len(keys) * i // wanted[p]] for i in range(1, wanted[p]))
        cuts = sorted([*cuts, *((b, uuid.uuid4().hex[:12]) for b in new - {b for b, _ in cuts})])
        change.properties[f"{self.name}_cuts"] = cuts
        return cuts

    def clear(self, change: Change) -> None:
        if change.base.parts(self.name):
            change.drop(self.name)
        change.properties[f"{self.name}_cuts"] = [["", "0"]]

    def range(self, snapshot: Snapshot, prefix: str, first: int | None = None) -> list[str]:
        """The parts that can hold keys with a prefix; with first, no more than are needed to have that many: parts between two others hold nothing else, and the log knows their rows."""
        cuts = self.cuts(snapshot)
        at = bisect_right([b for b, _ in cuts], prefix) - 1
        parts, sure = [cuts[at][1]], 0
        for i in range(at + 1, len(cuts)):
            if not cuts[i][0].startswith(prefix) or first is not None and sure >= first:
                break
            parts.append(cuts[i][1])
            if i + 1 < len(cuts) and cuts[i + 1][0].startswith(prefix):
                sure += sum(e["rows"] for e in snapshot.parts(self.name).get(cuts[i][1], ()))
        return parts

    def rows(self, prefix: str, first: int | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        snapshot = snapshot or self.ledger.snapshot()
        return snapshot.table(self.name, NAMES, self.range(snapshot, prefix, first)).filter(F.col("k").startswith(prefix))

    def search(self, prefix: str, file_type: str | None = None) -> DataFrame:
        """Paths of the files whose name starts like prefix, case and white space around it aside; none for a blank prefix."""
        p = prefix.strip().lower()
        out = (self.rows(p) if p else self.rows("").limit(0)).select("file_path")
        return out.filter(suffix(F.col("file_path")) == file_type.lower().lstrip(".")) if file_type else out

    def autocomplete(self, prefix: str, most: int = 10) -> DataFrame:
        """(filename, file_path) of the first names that start like prefix."""
        p = prefix.strip().lower()
        return (self.rows(p, most).orderBy("k").limit(most) if p else self.rows("").limit(0)).select("filename", "file_path")

    def contains(self, filename: str) -> bool:
        """Whether a file has this name, case aside."""
        return bool(filename) and not self.rows(filename.lower() + "\0").isEmpty()

    def stats(self) -> DataFrame:
        """Files, distinct name prefixes (with the empty one) and the longest name.

        In sorted order a name adds as many prefixes as it has letters beyond those it shares with the name before it: parts count theirs, then each part's first name is held against the
        last one of the part before.
        """
        names = self.ledger.snapshot().table(self.name, NAMES).select("k", "part", F.substring_index("k", "\0", 1).alias("n"))
        before = F.lag("n").over(Window.partitionBy("part").orderBy("k"))
        own = F.length("n") - common_letters(F.col("n"), F.col("b"))
        parts = names.withColumn("b", before).groupBy("part").agg(F.count("*").alias("files"), F.max(F.length("n")).alias("depth"), F.sum(F.when(F.col("b").isNotNull(), own)).alias("inner"), F.min("n").alias("n"), F.max("n").alias("z"))
        joined = parts.withColumn("b", F.coalesce(F.lag("z").over(Window.orderBy("n", "z")), F.lit("")))  # one row a part
        total = F.coalesce(F.sum(F.coalesce("inner", F.lit(0)) + own), F.lit(0)) + 1
        return joined.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), total.cast("long").alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("depth"))
