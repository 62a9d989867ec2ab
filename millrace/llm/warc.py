"""WARC archives with boundary-chain verification.

Writing uses the text writer with the record terminator as line separator, so archives go to any file system that
Spark reaches. Reading splits archives at the version line, wherever a split of the file begins; each piece is a
candidate record with its byte offset. A payload may hold the version line too. Every candidate therefore states its
successor (offset, header and Content-Length added up), and pointer jumping from each file's start, doubling the
stride a round, marks the candidates that the chain reaches. Only these are records; the others are parts of the
payload before them and are joined to it again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import folder, keep, sized_broadcast, small_batches

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: forty hexadecimal digits in eight groups of twenty bits."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: Rows of one payload from which on they are not brought together.
HEAVY = 2000


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) of each row.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the response, and
    refers_to of the others is its page_id. Payloads are grouped by digest and length; numbers only are shuffled.
    A row without a page_id is a response. Of rows that share the largest page_id all are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.encode("html", "UTF-8")))
    some = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    same = ["payload_digest", "payload_bytes"]
    copied = some.groupBy(same).agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"), F.count("*").alias("n")).where("first < last")
    copied = keep(copied, "copied")
    # A payload of many rows is joined by broadcast (there are rows / HEAVY of them at most), its rows then spread out.
    heavy = copied.where(F.col("n") > HEAVY).select(*same, F.col("last").alias("most"))
    light = copied.where(F.col("n") <= HEAVY).select(*same, "last", F.lit(0).alias("salt"))
    out = rows.join(sized_broadcast(heavy), same, "left")
    out = out.withColumn("salt", F.when(F.col("most").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) + 1).cast("int"))
    out = out.join(light, [*same, "salt"], "left").withColumn("last", F.coalesce("most", "last"))
    return out.select("page_id", "url", "html", *same, F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 0, records: int = 4096) -> None:
    """A record for each row, in files of at most ``records``: a response with an HTTP block, or a revisit without payload."""
    p = with_types(pages, least)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), text(c), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Target-URI", F.regexp_replace(text("url"), r"[\r\n]+", "%0A")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", text("payload_bytes")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    p.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).text(path)


def parse(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Header fields of a candidate, where its block begins, and its Content-Length; None if it is no record's head."""
    at = piece.find(b"\r\n\r\n")
    if at < 0:
        return None
    fields = dict(x.partition(": ")[::2] for x in piece[:at].decode("utf-8", "replace").split("\r\n"))
    size = fields.get("Content-Length", "")
    return (fields, at + 4, int(size)) if size.isascii() and size.isdigit() and len(size) < 16 else None


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP block."""
    return block.partition(b"\r\n\r\n")[2]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "X-Payload-Length", "WARC-Refers-To")
CANDIDATE = "file string, block long, rel long, size long, ahead long, whole boolean, fields array<string>, payload_bytes long, payload_digest string"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in reading order: each with its place within its split, how far ahead its successor is, and, where the
    piece holds the whole record, its payload's length and digest."""
    here, rel = None, 0
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for file, block, piece in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
            piece = piece.as_py() or b""
            if (file, block) != here:
                here, rel = (file, block), 0
            row: tuple = (rel, len(piece), None, False, None, None, None)
            if head := parse(piece):
                fields, start, length = head
                row = (rel, len(piece), len(MAGIC) + start + length + len(END), False, [fields.get(f, "") for f in FIELDS], None, None)
                if len(piece) >= start + length:
                    payload = payload_of(piece[start : start + length])
                    row = (*row[:3], True, row[4], len(payload), digest(payload))
            for column, value in zip(out, row, strict=True):
                column.append(value)
            rel += len(piece) + len(MAGIC)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], [c.split()[0] for c in CANDIDATE.split(", ")])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces themselves, with the same places."""
    here, rel = None, 0
    for batch in batches:
        places = []
        for file, block, piece in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
            if (file, block) != here:
                here, rel = (file, block), 0
            places.append(rel)
            rel += len(piece.as_py() or b"") + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(places, pa.int64()), batch.column("value")], ["file", "block", "rel", "body"])


def _exits(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Of each candidate of a split, the first successor outside the split."""
    leaves = dict(zip(frame["offset"], frame["next"], strict=True))
    for o in sorted(leaves, reverse=True):
        if pd.notna(n := leaves[o]) and n in leaves:
            leaves[o] = leaves[n]
    return pd.DataFrame({"file": key[0], "offset": list(leaves), "exit": pd.array(list(leaves.values()), "Int64")})


def _reached(key, frame: pd.DataFrame) -> pd.DataFrame:
    """Owner of each piece of a split, and the owner's end: the piece itself where the chain from the split's entry
    reaches it, else the last reached before. ahead: the end of the last one, if that lies beyond this split's pieces."""
    after = dict(zip(frame["offset"], frame["next"], strict=True))
    at, on, ahead = frame["entry"].iloc[0], set(), None
    while pd.notna(at) and at in after and pd.notna(after[at]):
        on.add(int(at))
        at = after[at]
    if pd.notna(at) and on and at not in after:
        if at > max(after):
            ahead = int(at)
        else:  # it ends where no record begins
            on.discard(max(on))
    order = sorted(after)
    owner, last = [], None
    for o in order:
        last = o if o in on else last
        owner.append(last)
    end = [None if x is None else int(after[x]) for x in owner]
    return pd.DataFrame({"file": key[0], "block": key[1], "offset": order, "owner": pd.array(owner, "Int64"), "end": pd.array(end, "Int64"), "ahead": pd.array([ahead] * len(order), "Int64")})


RECORD = ["file", "offset", "fields", "payload_bytes", "payload_digest", "payload"]


def _joined(bodies: bool):
    """Records whose payload holds version lines: their pieces, in order, with the lines between them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, offset, parts in zip(*(batch.column(c).to_pylist() for c in ("file", "owner", "bodies")), strict=True):
                piece = MAGIC.encode().join(x["body"] for x in parts)
                fields, start, length = parse(piece)  # whole: pieces are those up to the record's end
                payload = payload_of(piece[start : start + length])
                rows.append((file, offset, [fields.get(f, "") for f in FIELDS], len(payload), digest(payload), payload if bodies else None))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], RECORD)

    return run


def verified_records(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """(file, offset, fields, payload_bytes, payload_digest, payload) of the records of the archives below ``path``.

    A file that does not begin with a record has none. payload is null unless ``bodies``. A record counts if its end is
    the end of the file or the place of a version line. One with a wrong length, or cut short, is left out, and with it
    what follows in its file: where the chain breaks, nothing says which version lines are true.
    """
    small_batches(spark)
    text = spark.read.option("lineSep", MAGIC).text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = keep(text.mapInArrow(_candidates, CANDIDATE), "pieces")

    # Byte offsets: lengths before the split (sums by split) and within it.
    totals = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    base = totals.select("file", "block", (F.sum("total").over(W.partitionBy("file").orderBy("block")) - F.col("total") - len(MAGIC)).alias("base"))
    placed = pieces.join(sized_broadcast(keep(base, "splits")), ["file", "block"]).withColumn("offset", F.col("base") + F.col("rel"))
    chain = keep(placed.where("offset >= 0").select("file", "block", "offset", (F.col("offset") + F.col("ahead")).alias("next")), "chain")

    # Pointer jumping between splits, the stride doubling each round.
    jump = keep(chain.groupBy("file", "block").applyInPandas(_exits, "file string, offset long, exit long").where("exit is not null"), "jump")
    entries = keep(chain.where("offset = 0").select("file", "offset"), "entries")
    known = entries.count()
    while known:
        entries = keep(entries.union(entries.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))).distinct(), "entries")
        if (now := entries.count()) == known:
            break
        known = now
        far = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        jump = keep(jump.join(far, ["file", "exit"]).select("file", "offset", F.col("further").alias("exit")), "jump")

    entry = keep(chain.join(entries, ["file", "offset"], "left_semi").groupBy("file", "block").agg(F.min("offset").alias("entry")), "entry")
    own = chain.join(sized_broadcast(entry), ["file", "block"], "left").groupBy("file", "block").applyInPandas(_reached, "file string, block long, offset long, owner long, end long, ahead long")
    own = keep(own, "owners")
    last = own.groupBy("file", "block").agg(F.max(F.struct(F.col("owner").alias("o"), F.col("end").alias("e"))).alias("last"), F.max("ahead").alias("ahead"))
    before = last.select("file", "block", F.max(F.when(F.col("last.o").isNotNull(), F.col("last"))).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    own = own.join(sized_broadcast(keep(before, "before")), ["file", "block"])
    own = own.select("file", "offset", F.when(F.col("owner").isNull(), F.col("before")).otherwise(F.struct(F.col("owner").alias("o"), F.col("end").alias("e"))).alias("own"))
    own = own.select("file", "offset", F.col("own.o").alias("owner"), F.col("own.e").alias("end")).where("offset < end")
    # Of each split the last record may end in another: at that one's entry, or at the end of the file.
    ends = totals.groupBy("file").agg((F.sum("total") - len(MAGIC)).alias("length"))
    ahead = last.where("ahead is not null").select("file", F.col("last.o").alias("owner"), F.col("ahead").alias("entry"))
    broken = ahead.join(entry.select("file", "entry"), ["file", "entry"], "left_anti").join(ends, "file").where("entry != length").select("file", "owner")
    own = own.join(sized_broadcast(keep(broken, "broken")), ["file", "owner"], "left_anti")

    parts = placed.join(own, ["file", "offset"])
    heads = parts.where("owner = offset and fields is not null")
    whole = heads.where("whole").select("file", "offset", "fields", "payload_bytes", "payload_digest", F.lit(None).cast("binary").alias("payload"))
    apart = keep(heads.where("not whole" if not bodies else "true").select("file", "owner"), "apart")
    if not apart.limit(1).count():
        return whole
    # Read these records' pieces once more, for their bodies.
    need = keep(parts.join(sized_broadcast(apart), ["file", "owner"], "left_semi").select("file", "block", "rel", "offset", "owner"), "need")
    found = text.mapInArrow(_bodies, "file string, block long, rel long, body binary").join(sized_broadcast(need), ["file", "block", "rel"])
    split = found.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "body"))).alias("bodies"))
    joined = split.mapInArrow(_joined(bodies), "file string, offset long, fields array<string>, payload_bytes long, payload_digest string, payload binary")
    return joined if bodies else whole.union(joined)


def read(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact, payload) of each record. A revisit has
    the length and digest that its header states; a response those of the payload that was read. intact: whether a
    response's payload has the digest that its header states."""
    r = verified_records(spark, path, bodies)
    f = {name: F.col("fields")[k] for k, name in enumerate(FIELDS)}
    page = lambda x: F.regexp_extract(x, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    revisit = f["WARC-Type"] == "revisit"
    stated = F.regexp_replace(f["WARC-Payload-Digest"], "^sha1:", "")
    return r.select(
        page(f["WARC-Record-ID"]).alias("page_id"),
        f["WARC-Target-URI"].alias("url"),
        f["WARC-Type"].alias("record_type"),
        F.when(revisit, page(f["WARC-Refers-To"])).alias("refers_to"),
        F.when(revisit, f["X-Payload-Length"].try_cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(~revisit, F.col("payload_digest") == stated).alias("intact"),
        "payload",
    )


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back, without the payloads.

    A null html is an empty payload. Rows with a null page_id come back with a null one. Repeated rows give a record
    each. An empty table gives no rows. Other columns are ignored.
    """
    path = folder(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path, bodies=False).drop("payload")
