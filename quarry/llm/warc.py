"""WARC archives and their Merkle fixity audit.

Pages become WARC/1.0 response records in files of neighbouring page ids; within a file records are ordered and have offsets. Archives are
written as such files (`write_archive`) and read back by their Content-Length fields (`read_archive`).

A leaf of a file's tree is a slot: the records of one page id in order, so a lost or added record moves no other leaf. A leaf's hash covers its records'
hashes (SHA-256) and byte ranges within the leaf; a node covers `fanout` neighbouring slots, their hashes and their ordered offset ranges, counted
from the node's first byte, level by level up to one hash a file, then ranges of files up to one root. Both replicas' trees are stored by level. The
audit compares the roots and, level by level, reads only children of nodes that differ; it ends where none differ, so an intact replica costs
one comparison. Only records of differing leaves are compared with each other, which tells changed, lost and added ones.

Null urls and pages count as empty. Urls with control characters are written encoded, so that they end no header and forge no field. Records without a page id are dealt to files of negative numbers by their hashes (so a changed one counts as
one lost and one added). Repeated rows are records of their own; equal ones are counted before they are dealt, and records of one page id are ordered by
their hashes and summed up by the hashes' beginnings, so neither fills a task. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_of, prepare, stored

DATE, PER_FILE, FANOUT = "2024-01-01T00:00:00Z", 1_000, 16
CRLF = "\r\n"
#: Megabytes of records without a page id in one file.
LOOSE_MB = 8.0
#: Characters that no header's value may have, and the header that says how they are written.
CONTROL, ENCODED = r"[\x00-\x1F\x7F]", "X-Target-Encoding"


def records(pages: DataFrame, date: str = DATE, per_file: int = PER_FILE, contents: bool = True, loose_files: int | None = None) -> DataFrame:
    """file, slot, seq, page_id, key, first_byte, length, hash, n and (with contents, then n is 1) record of every page.

    Records are hashed where they are read. Without contents only hashes and lengths are dealt to the files, and n equal records are one row with the
    place of the first. Records without a page id go to `loose_files` files (by default as many as their table's size asks for).
    """
    url, html, number = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # A line break in a header's value would end it: a url with control characters is written as a form's value, and a header says so.
    odd = url.rlike(CONTROL)
    shown, note = F.when(odd, F.url_encode(url)).otherwise(url), F.when(odd, F.lit(f"{CRLF}{ENCODED}: form")).otherwise(F.lit(""))
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"), html)
    record = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:sha256:"), F.sha2(F.concat(number, F.lit(" "), url), 256),
        F.lit(f">{CRLF}WARC-Date: {date}{CRLF}X-Page-ID: "), number, F.lit(f"{CRLF}WARC-Target-URI: "), shown, note, F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.sha2(html, 256),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block, F.lit(CRLF * 2),
    )
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(url, 256).alias("key"), record.alias("record"))
    rows = rows.select("page_id", "key", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("length"), *(["record"] if contents else []))
    return placed(filed(rows, per_file, loose_files or parts_of(pages, LOOSE_MB, 1)))


def filed(rows: DataFrame, per_file: int, loose_files: int) -> DataFrame:
    """Records with their file and slot."""
    loose = F.pmod(F.xxhash64("key", "hash"), F.lit(loose_files * per_file))
    file = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.floor(loose / per_file))
    slot = F.coalesce(F.pmod("page_id", F.lit(per_file)), F.pmod(loose, F.lit(per_file)))
    return rows.select(file.cast("long").alias("file"), slot.cast("long").alias("slot"), "*")


def placed(rows: DataFrame) -> DataFrame:
    """Records (file, slot, page_id, key, hash, length, perhaps record) with their number and first byte in the file; parts of slots are summed up first."""
    one = ["file", "slot", "page_id", "key", "hash", "length"]
    rows = rows.withColumn("n", F.lit(1).cast("long")) if "record" in rows.columns else rows.groupBy(*one).agg(F.count("*").alias("n"))
    rows = rows.withColumn("part", part_of())
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within, over = Window.partitionBy("file", "slot", "part").orderBy("hash", "key"), Window.partitionBy("file").orderBy("slot", "part")
    sums = rows.groupBy("file", "slot", "part").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("length")).alias("_l"))
    sums = sums.select("file", "slot", "part", before(over, "_n").alias("_seq"), before(over, "_l").alias("_at"))
    out = rows.withColumn("_k", before(within, F.col("n"))).withColumn("_b", before(within, F.col("n") * F.col("length"))).join(sums, ["file", "slot", "part"])
    return out.select("file", "slot", (F.col("_seq") + F.col("_k")).alias("seq"), "page_id", "key", (F.col("_at") + F.col("_b")).alias("first_byte"), "length", "hash", "n", *(["record"] if "record" in rows.columns else []))


def part_of() -> Column:
    return F.substring("hash", 1, 3)


def write_archive(pages: DataFrame, folder: str, per_file: int = PER_FILE) -> None:
    """One WARC file in folder/file=N for every file; the bytes of a file are its records one after the other."""
    rows = records(pages, per_file=per_file)
    rows = rows.repartition(parts_of(pages, 32.0, 1), "file").sortWithinPartitions("file", "seq")
    end = CRLF * 2  # the writer puts it after every record, and every record ends with it
    rows.select("file", F.expr(f"left(record, length(record) - {len(end)})").alias("value")).write.partitionBy("file").option("lineSep", end).option("maxRecordsPerFile", 0).text(folder)


def parse(data: bytes):
    """(first byte, record, fields, html) of every record of a WARC file, read by their lengths; bytes that do not parse are a record of unknown content, up to the next one."""
    at = 0
    while 0 <= at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) for line in data[at:head_end].split(b"\r\n")[1:] if b": " in line) if head_end >= 0 and data.startswith(b"WARC/", at) else {}
        size = fields.get(b"Content-Length", b"")
        end = head_end + 4 + int(size) + 4 if size.isdigit() else -1
        if 0 <= end <= len(data) and data[end - 4 : end] == b"\r\n\r\n":
            block = data[head_end + 4 : end - 4]
            yield at, data[at:end], fields, block[block.find(b"\r\n\r\n") + 4 :]
            at = end
        else:
            after = data.find(b"\r\n\r\nWARC/1.0\r\n", at + 1)
            end = after + 4 if after >= 0 else len(data)
            yield at, data[at:end], {}, None
            at = end


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """file, seq, first_byte, length, hash, page_id, url, html of every record of the WARC files that `write_archive` wrote, from their bytes alone."""
    import hashlib
    from urllib.parse import unquote_plus

    columns = ["file", "seq", "first_byte", "length", "hash", "page_id", "url", "html"]

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, text = [], lambda x: None if x is None else x.decode("utf-8", "replace")
                for k, (at, record, fields, html) in enumerate(parse(bytes(data))):
                    number = fields.get(b"X-Page-ID", b"")
                    page = int(number) if number.removeprefix(b"-").isdigit() else None
                    url = text(fields.get(b"WARC-Target-URI"))
                    if url is not None and fields.get(ENCODED.encode()) == b"form":
                        url = unquote_plus(url)
                    rows.append((int(path.rsplit("file=", 1)[1].split("/", 1)[0]), k, at, len(record), hashlib.sha256(record).hexdigest(), page, url, text(html)))
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").filter(F.col("path").contains("file="))
    return files.mapInPandas(run, "file long, seq long, first_byte long, length long, hash string, page_id long, url string, html string")


def archived(archive: DataFrame, per_file: int, loose_files: int) -> DataFrame:
    """The records of `read_archive` for an audit: placed by page id, whatever file holds them."""
    return placed(filed(archive.select("page_id", F.sha2(F.coalesce("url", F.lit("")), 256).alias("key"), "hash", "length"), per_file, loose_files))


def steps(fanout: int, n: int) -> int:
    return next(k for k in range(64) if fanout**k >= max(1, n))


def heights(*tables: DataFrame, fanout: int) -> tuple[int, int]:
    """(levels within a file, levels over files) that lead to one node each."""
    most = reduce(DataFrame.unionAll, [t.select("file", "slot") for t in tables]).agg(F.max("slot").alias("s"), F.min("file").alias("a"), F.max("file").alias("z")).first()
    return (steps(fanout, most["s"] + 1), steps(fanout, max(most["z"], -1 - most["a"]) + 1)) if most["s"] is not None else (0, 0)


def covered(number: str) -> Column:
    """Hash over ordered children (number, hash, size): each with its range of bytes from the node's start; at most `fanout` of them."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    add = lambda s, x: F.struct((s["at"] + x["size"]).alias("at"), F.concat(s["text"], x[number].cast("string"), F.lit(" "), s["at"].cast("string"), F.lit(" "), x["size"].cast("string"), F.lit(" "), x["hash"], F.lit("\n")).alias("text"))
    return F.sha2(F.aggregate(F.sort_array(F.collect_list(F.struct(number, "size", "hash"))), start, add)["text"], 256)


def slots(rows: DataFrame) -> DataFrame:
    """file, node, hash, size of the leaves, in two steps: parts of slots by the beginnings of hashes, then slots."""
    told = F.transform(F.sort_array(F.collect_list(F.struct("hash", "length", "n"))), lambda x: F.concat_ws(" ", x["hash"], x["length"].cast("string"), x["n"].cast("string")))
    parts = rows.groupBy("file", "slot", part_of().alias("part")).agg(F.sha2(F.array_join(told, "\n"), 256).alias("hash"), F.sum(F.col("length") * F.col("n")).alias("size"))
    return parts.groupBy("file", F.col("slot").alias("node")).agg(covered("part").alias("hash"), F.sum("size").alias("size"))


def tree(rows: DataFrame, height: tuple[int, int], fanout: int = FANOUT) -> list[DataFrame]:
    """file, node, hash, size of every node, a stored table for each level from the leaves to the root; over the files the node numbers are file numbers and file is 0."""
    levels = [stored(slots(rows), "tree0")]
    for step in range(sum(height)):
        below = levels[-1]
        if step == height[0]:
            below = below.select(F.lit(0).cast("long").alias("file"), F.col("file").alias("node"), "hash", "size")
        above = below.groupBy("file", F.floor(F.col("node") / fanout).alias("parent")).agg(covered("node").alias("hash"), F.sum("size").alias("size"))
        levels.append(stored(above.withColumnRenamed("parent", "node"), f"tree{step + 1}"))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """file and node of the nodes that are not the same in both."""
    both = a.select("file", "node", F.col("hash").alias("x")).join(b.select("file", "node", F.col("hash").alias("y")), ["file", "node"], "full_outer")
    return both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node")


def damaged_slots(a: list[DataFrame], b: list[DataFrame], height: tuple[int, int], fanout: int = FANOUT) -> DataFrame | None:
    """file and slot of the leaves that differ, found from the root down; None as soon as nothing differs. Levels below equal nodes are not read."""
    bad = None
    for level in range(sum(height), -1, -1):
        x, y = a[level], b[level]
        if bad is not None:
            span = bad.agg(F.min("file"), F.max("file"), F.min("node"), F.max("node")).first()
            up = bad.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
            if level == height[0] and height[1]:  # from ranges of files to files, each a single node
                parts, on = [F.col("file").between(span[2] * fanout, span[3] * fanout + fanout - 1)], F.floor(F.col("file") / fanout) == F.col("_n")
            else:
                parts = [F.col("file").between(span[0], span[1]), F.col("node").between(span[2] * fanout, span[3] * fanout + fanout - 1)]
                on = (F.col("file") == F.col("_f")) & (F.floor(F.col("node") / fanout) == F.col("_n"))
            x, y = (t.filter(reduce(Column.__and__, parts)).join(up, on, "left_semi") for t in (x, y))
        bad = stored(differing(x, y), "differing")
        if bad.isEmpty():
            return None
    return bad.select("file", F.col("node").alias("slot"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that only one of two tables has; one that changed under its page id and url is one row."""
    on = lambda x, y, by: reduce(Column.__and__, [x[c].eqNullSafe(y[c]) for c in by])
    x, y, whole = a.alias("x"), b.alias("y"), ["file", "slot", "page_id", "key", "hash"]
    both = x.join(y, on(x, y, whole), "full_outer").withColumn("same", F.least(F.coalesce("x.n", F.lit(0)), F.coalesce("y.n", F.lit(0))))

    def rest(side: str) -> DataFrame:
        """The copies that the other table lacks, one row each."""
        col = lambda c: F.col(f"{side}.{c}")
        more = both.filter(col("n") > F.col("same")).withColumn("i", F.explode(F.sequence(F.col("same"), col("n") - 1)))
        rows = more.select(*(col(c).alias(c) for c in whole), (col("seq") + F.col("i")).alias("seq"), (col("first_byte") + F.col("i") * col("length")).alias("first_byte"), col("length").alias("length"))
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("file", "slot", "page_id", "key").orderBy("hash", "seq")))

    x, y = rest("x").alias("x"), rest("y").alias("y")
    pairs = x.join(y, on(x, y, ["file", "slot", "page_id", "key", "nth"]), "full_outer")
    state = F.when(F.col("y.hash").isNull(), "lost").when(F.col("x.hash").isNull(), "added").otherwise("changed")
    first = lambda c: F.coalesce(f"x.{c}", f"y.{c}").alias(c)
    return pairs.select(first("file"), F.col("x.seq").alias("seq"), first("page_id"), F.col("x.first_byte").alias("first_byte"), F.col("x.length").alias("length"), state.alias("state"), F.col("x.hash").alias("expected_sha256"), F.col("y.hash").alias("found_sha256"))


def audit(kept: DataFrame, replica: DataFrame, fanout: int = FANOUT, per_file: int = PER_FILE) -> DataFrame:
    """The damaged records: file, seq, page_id, first_byte, length (as kept; null for added ones), state (changed, lost, added) and both hashes."""
    prepare(kept.sparkSession)
    loose = parts_of(kept, LOOSE_MB, 1)
    return audit_records(*(stored(records(x, per_file=per_file, contents=False, loose_files=loose), "records") for x in (kept, replica)), fanout=fanout)


def audit_archives(spark: SparkSession, kept: str, replica: str, fanout: int = FANOUT, per_file: int = PER_FILE) -> DataFrame:
    """The same for two folders of WARC files."""
    prepare(spark)
    a, b = read_archive(spark, kept), read_archive(spark, replica)
    return audit_records(*(stored(archived(x, per_file, 1), "records") for x in (a, b)), fanout=fanout)


def audit_records(a_rows: DataFrame, b_rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The same for two replicas' records (file, slot, seq, page_id, key, first_byte, length, hash, n)."""
    height = heights(a_rows, b_rows, fanout=fanout)
    bad = damaged_slots(tree(a_rows, height, fanout), tree(b_rows, height, fanout), height, fanout)
    if bad is None:
        return compared(a_rows.limit(0), b_rows.limit(0))
    return compared(a_rows.join(bad, ["file", "slot"], "left_semi"), b_rows.join(bad, ["file", "slot"], "left_semi"))
