"""WARC files of pages, and a Merkle fixity audit of their replicas."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, running_sum, shared_dir

#: Bytes after which a file is closed.
FILE_BYTES = 32_000_000
#: Children of an inner node, as a power of two.
FAN_BITS = 4
#: Tasks that files are dealt over at most.
MOST_TASKS = 50_000
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, seq long, offset long, length long, page_id long"


def record(page_id: int | None, url: str | None, html: str | None, place: str = "") -> bytes:
    """One WARC/1.1 resource record as a gzip member; its bytes follow from the page and its place in the files.

    The place makes the record's id its own even for pages that repeat; a page without a url is its own target.
    """
    payload = (html or "").encode()
    digest = hashlib.sha256(payload).hexdigest()
    name = "" if page_id is None else str(page_id)
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}:{name}:{digest}')}>\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Target-URI: {quote(url or f'urn:page:{name}', safe=':/?#[]@!$&()*+,;=%~')}\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    return gzip.compress(head + payload + b"\r\n\r\n", 6, mtime=0)


def payload(member: bytes) -> bytes:
    """The payload of a record."""
    return gzip.decompress(member).split(b"\r\n\r\n", 1)[1][:-4]


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as ``.warc.gz`` files below ``folder``; returns the index of their records.

    The index has ``(file, seq, offset, length, page_id)`` for each record, a gzip member of its own. A task writes the rows
    of its partition in order, under a temporary name that is then changed, so a task that runs again
    replaces equal bytes by equal bytes. Nulls in url or html count as empty; a null page_id stays null
    in the index; repeated rows are records of their own; an empty table writes no files.
    """

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        task, files, held, rows, size = TaskContext.get(), 0, [], [], 0

        def close():
            nonlocal files, held, rows, size
            name = f"part-{task.partitionId():06d}-{files:05d}.warc.gz"
            draft = f"{base}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                for one in held:
                    out.write(one)
            store.move(draft, f"{base}/{name}")
            columns = [[name] * len(rows), *map(list, zip(*rows))]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4])], names=["file", "seq", "offset", "length", "page_id"])
            files, held, rows, size = files + 1, [], [], 0
            return batch

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                one = record(page_id, url, html, f"{task.partitionId()}/{files}/{len(rows)}")
                rows.append((len(rows), size, len(one), page_id))
                held.append(one)
                size += len(one)
                if size >= file_bytes:
                    yield close()
        if held:
            yield close()

    return cut(map_batches(pages.select("page_id", "url", "html"), run, INDEX))


def leaves(folder: str, index: DataFrame, of=bytes) -> DataFrame:
    """``(file, seq, hash)``: the SHA-256 of each record's range of bytes as a replica has it.

    Ranges come from the index and not from the replica's own headers, which may be what is damaged.
    A range that the file no longer reaches hashes as the bytes that are left; a file that is missing
    gives no leaves. ``of`` says what of a range is hashed, by default all of it. The index reaches a file's task as one row of arrays, bounded by the size of a file.
    """

    def run(batches):
        for batch in batches:
            store, base = fs.FileSystem.from_uri(folder)
            for name, ranges in zip(batch.column("file").to_pylist(), batch.column("ranges").to_pylist()):
                path = f"{base}/{name}"
                if store.get_file_info(path).type == fs.FileType.NotFound:
                    continue
                seq, out = [], []
                with store.open_input_file(path) as f:
                    size = f.size()
                    for r in ranges:
                        n = max(0, min(r["length"], size - r["offset"]))
                        seq.append(r["seq"])
                        out.append(hashlib.sha256(of(f.read_at(n, r["offset"]) if n else b"")).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seq)), pa.array(seq, pa.int64()), pa.array(out)], names=["file", "seq", "hash"])

    by_file = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "offset", "length"))).alias("ranges"))
    return _by_file(by_file, index).mapInArrow(run, "file string, seq long, hash string")


def tree(replica: DataFrame, index: DataFrame) -> list[DataFrame]:
    """The levels of a replica's Merkle tree from its leaves up, each ``(level, file, node, first, last, hash)``.

    A leaf binds a record's hash to its range of offsets; an inner node hashes its (at most sixteen)
    children in order and spans their ranges. When each file has come to one node, files are numbered
    by name and a tree is built over them in the same way, up to one root. All levels together are
    little larger than the index.
    """
    ranges = index.select("file", "seq", "offset", (F.col("offset") + F.col("length")).alias("end"))
    first = replica.join(ranges, ["file", "seq"])
    text = F.concat_ws(":", "hash", F.col("offset").cast("string"), F.col("end").cast("string"))
    level = cut(first.select("file", F.col("seq").alias("node"), F.col("offset").alias("first"), F.col("end").alias("last"), F.sha2(text, 256).alias("hash")))
    levels = [level]
    top = index.agg(F.max("seq")).first()[0] or 0
    while top:
        level, top = cut(_parents(level)), top >> FAN_BITS
        levels.append(level)
    return levels


def file_tree(roots: DataFrame, names: DataFrame) -> list[DataFrame]:
    """The levels above the files: ``roots`` has one node for each file, ``names`` the number of each file."""
    level = roots.join(names, "file").select(F.lit("").alias("file"), F.col("number").alias("node"), F.lit(0).cast("long").alias("first"), "last", F.sha2(F.concat_ws(":", "file", "hash"), 256).alias("hash"))
    level = cut(level)
    levels = [level]
    top = names.agg(F.max("number")).first()[0] or 0
    while top:
        level, top = cut(_parents(level)), top >> FAN_BITS
        levels.append(level)
    return levels


def _parents(level: DataFrame) -> DataFrame:
    up = level.groupBy("file", F.shiftright("node", FAN_BITS).alias("node"))
    up = up.agg(F.sort_array(F.collect_list(F.struct("node", "first", "last", "hash"))).alias("below"))
    text = F.array_join(F.transform("below", lambda c: F.concat_ws(":", c["node"].cast("string"), c["first"].cast("string"), c["last"].cast("string"), c["hash"])), "|")
    return up.select("file", "node", F.element_at("below", 1)["first"].alias("first"), F.element_at("below", -1)["last"].alias("last"), F.sha2(text, 256).alias("hash"))


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of a level whose hashes differ or that one side lacks."""
    left = a.select("file", "node", F.col("hash").alias("a"))
    right = b.select("file", "node", F.col("hash").alias("b"))
    return left.join(right, ["file", "node"], "full_outer").where("not a <=> b").select("file", "node")


def _descend(levels_a: list[DataFrame], levels_b: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """Leaves that differ below the nodes ``wanted(file, node)`` of the top level; only their branches are read."""
    for a, b in zip(levels_a[-2::-1], levels_b[-2::-1]):
        up = wanted.withColumnRenamed("node", "up")
        below = lambda x: x.withColumn("up", F.shiftright("node", FAN_BITS)).join(up, ["file", "up"], "left_semi")  # noqa: E731, B023
        wanted = cut(_differ(below(a), below(b)))
    return wanted


def audit(folder_a: str, folder_b: str, index: DataFrame) -> DataFrame:
    """``(file, seq)`` of the records whose bytes differ between two replicas.

    The roots are compared first; if they agree nothing else is read. Otherwise the tree over files is
    descended along nodes that differ, and then the trees of only the files found. A file that one
    replica lacks differs in all its records. An empty index has no difference.
    """
    spark = index.sparkSession
    a, b = tree(leaves(folder_a, index), index), tree(leaves(folder_b, index), index)
    names = number_files(index.select("file").distinct())
    fa, fb = file_tree(a[-1], names), file_tree(b[-1], names)
    root = _differ(fa[-1], fb[-1])
    if root.isEmpty():
        return spark.createDataFrame([], "file string, seq long")
    bad = _descend(fa, fb, root).join(names, F.col("node") == F.col("number")).select(names["file"], F.lit(0).cast("long").alias("node"))
    return _descend(a, b, cut(bad)).withColumnRenamed("node", "seq")


def number_files(names: DataFrame) -> DataFrame:
    """``(file, number)`` in order of names; there is one row for each 32 MB of records."""
    hundred = F.substring("file", 1, 9)  # of the partitions that the files are named after
    return cut(running_sum(names.select("file"), "file", hundred, F.lit(1), "number").select("file", F.col("number").cast("long").alias("number")))


def _by_file(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows dealt by file into as many tasks as there are files (bounded): each stands for a whole file to read, however small it is."""
    return rows.repartition(max(1, min(MOST_TASKS, index.select("file").distinct().count())), "file")


def replicate(folder: str, target: str, index: DataFrame, damage: Column) -> None:
    """Copy each file to ``target``, one bit in the middle of a record flipped where the column ``damage`` holds.

    It stands for a second store with bit rot, to try the audit on.
    """

    def run(batches):
        (source, base), (store, out) = fs.FileSystem.from_uri(folder), fs.FileSystem.from_uri(target)
        store.create_dir(out)
        for batch in batches:
            for name, places in zip(batch.column("file").to_pylist(), batch.column("places").to_pylist()):
                with source.open_input_file(f"{base}/{name}") as f:
                    content = bytearray(f.read())
                for at in places:
                    content[at] ^= 1
                draft = f"{out}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(draft) as f:
                    f.write(content)
                store.move(draft, f"{out}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    place = F.when(damage, F.col("offset") + F.floor(F.col("length") / 2).cast("long"))
    by_file = index.groupBy("file").agg(F.collect_list(place).alias("places"))
    cut(_by_file(by_file, index).mapInArrow(run, "file string"))


def fixity(pages: DataFrame, damage: Column) -> DataFrame:
    """``(page_id, payload_sha256, status)`` of every page after writing, copying and auditing.

    Pages are written as WARC files, copied to a second replica in which records with ``damage`` lose a
    bit, and audited; status is ``damaged`` for the records that the audit locates, else ``intact``.
    The payload's digest is taken from the first replica's files. See :func:`write` for nulls.
    """
    spark = pages.sparkSession
    one, two = shared_dir(spark), shared_dir(spark)
    index = write(pages, one)
    replicate(one, two, index, F.coalesce(damage, F.lit(False)))
    bad = audit(one, two, index).withColumn("bad", F.lit(True))
    joined = payload_digests(one, index).join(bad, ["file", "seq"], "left")
    return joined.select("page_id", "payload_sha256", F.when(F.col("bad"), "damaged").otherwise("intact").alias("status"))


def payload_digests(folder: str, index: DataFrame) -> DataFrame:
    """``(file, seq, page_id, payload_sha256)`` read back from a replica's files."""
    read = leaves(folder, index, of=payload).withColumnRenamed("hash", "payload_sha256")
    return read.join(index.select("file", "seq", "page_id"), ["file", "seq"])
