r"""WARC archives: writing one gzip member per record, and reading them back by byte ranges.

Writing. Of records with equal payloads of at least `least_bytes`, that of the smallest page_id is a
response, the others revisit it; all else is a response. Payloads are equal if their SHA-256 is. Archives are written by the text writer, whose rows may be any bytes: the last byte of a
gzip member is the top byte of its length, zero below 16 MB, so it serves as the line separator and
files hold nothing but members (a longer one is followed by an empty member). So any file system that
Spark writes to will do, and its commit protocol holds.

Reading. Spark's line reader takes the gzip magic as separator, so files are split at any byte and a task
owns the pieces that begin behind a magic inside its range. A piece is a record's beginning if its gzip
header and first bytes decode to a WARC version line; else the magic stood inside compressed
data, and the piece belongs to the record before it. A piece too short to decide joins those after it until
it is decided. Where such a false magic is the first of another
task's range, or a piece is undecided at a range's end, the pieces are put together in a second step, by file.

Name archives with any suffix but .gz, since the reader would decompress those as a whole.

A null payload is empty. A null page_id: the record has none; it revisits the smallest id with its payload,
if there is one, and else is a response. Of rows that repeat the smallest id, all are responses. Empty tables make empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import join_split, map_batches, only, written

MAGIC = b"\x1f\x8b\x08"
LEVEL = 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of a candidate that are decoded to see whether a record begins.
PROBE = 512
#: Tasks that put torn records together, at most; each holds one file's fragments at a time.
TORN_TASKS = 1000


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "about:blank"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """An uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: {_urn(page_id) if page_id is not None else uuid.uuid4().urn}")
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero (an empty member follows where it has to)."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + member(b"")


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): what each page's record will be.

    Which page revisits which is decided on (page_id, digest) alone; payloads meet the decisions by their own page's key, so
    equal payloads are dealt like any others.
    """
    rows = only(pages, "page_id", "url", "html")
    rows = rows.withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit(b""))).drop("html")
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    narrow = written(rows.select("page_id", "digest", (F.octet_length("payload") >= least_bytes).alias("large")), "digests")
    total = narrow.count()
    shared = narrow.where("large").groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1 AND least IS NOT NULL"), "shared")
    own = F.concat(F.lit("p"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":")).cast("binary")  # of a page and its content
    decided = join_split(narrow, shared, "digest", "n", total, "least").where("least IS NOT NULL AND (page_id IS NULL OR page_id != least)")
    decided = written(decided.groupBy(F.concat(own, "digest").alias("own")).agg(F.min("least").alias("refers_to"), F.count("*").alias("n")), "revisits")
    keyed = rows.select("page_id", "url", "payload", F.concat(own, "digest").alias("own"))
    return join_split(keyed, decided, "own", "n", total, "refers_to").drop("own")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> str:
    """Write the pages' records below `path`."""

    def run(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*r))[:-1] for r in rows], pa.binary())], names=["value"])

    lines = map_batches(plan(pages, least_bytes), run, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    return path


def _inflate(data: bytes) -> bytes | None:
    """The content of one or more members; None if the last one is cut short or damaged."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            return None
        if not d.eof:
            return None
        data = d.unused_data
        if data and not data.startswith(MAGIC):
            break  # what follows a member without a magic is no part of the archive
    return b"".join(out)


def begins_record(data: bytes) -> bool | None:
    """Whether the bytes decode to the beginning of a WARC record; None if they are too few to tell."""
    for part in (data[:PROBE], data):
        d = zlib.decompressobj(31)
        try:
            found = d.decompress(part, 5)
        except zlib.error:
            return False
        if len(found) == 5 or d.eof or not b"WARC/".startswith(found):
            return found == b"WARC/"
    return None


def _judged(pieces: Iterator[bytes]) -> Iterator[tuple[bool | None, bytes]]:
    """(whether a record begins, piece): a beginning comes with the pieces it took to decide, whose magics lie inside it."""
    ahead: deque[bytes] = deque()
    while ahead or (more := next(pieces, None)) is not None:
        if not ahead:
            ahead.append(more)
        taken, data = 1, ahead[0]
        while (begins := begins_record(data)) is None:
            if taken == len(ahead):
                if (more := next(pieces, None)) is None:
                    break
                ahead.append(more)
            data += ahead[taken]
            taken += 1
        if begins:
            for _ in range(taken):
                ahead.popleft()
            yield True, data
        else:
            yield begins, ahead.popleft()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of a decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a record is shorter than its Content-Length")
    if rest[size:].strip(b"\r\n"):
        raise ValueError("a record is longer than its Content-Length")
    return fields, rest[:size]


def page_of(data: bytes) -> tuple:
    """(page_id, url, type, digest, payload bytes, refers_to, payload) of a decoded record; a response's digest is checked."""
    fields, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])
    size = {n.strip().lower(): v.strip() for n, _, v in lines}.get("content-length")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if digest and digest32(payload) != digest:
            raise ValueError(f"the payload of page {fields.get('page-id')} doesn't have its digest")
        size = len(payload)
    number = lambda x: None if x is None else int(x)
    return number(fields.get("page-id")), fields.get("warc-target-uri"), kind, digest, number(size), number(fields.get("refers-to-page-id")), payload if kind == "response" else None


_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
_PLACE = [("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("fragment", pa.binary())]
RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
FRAGMENTS = "path string, block bigint, seq bigint, fragment binary"


def _split_records(pieces: Iterator[tuple[bytes, str, int]], payloads: bool) -> Iterator[tuple]:
    """Rows of fields and place: records that are whole in one range, and fragments that aren't."""

    def torn(data):
        nonlocal seq
        seq += 1
        return (*[None] * 7, *place, seq, data)

    def closed():
        if held is not None:
            data = _inflate(held)
            if data is None:
                yield torn(held)
            else:
                page = page_of(data)
                yield (*(page if payloads else (*page[:6], None)), None, None, None, None)

    for place, group in groupby(pieces, key=itemgetter(1, 2)):
        seq, held, unsure = 0, None, []
        # at a file's start: without what stands before its first magic
        for begins, data in _judged(MAGIC + p for p, _, _ in islice(group, place[1] == 0, None)):
            if begins:
                if held is None:
                    yield from map(torn, unsure)
                else:
                    held += b"".join(unsure)
                    yield from closed()
                held, unsure = data, []
            elif begins is None or unsure:
                unsure.append(data)
            elif held is not None:
                held += data
            else:
                yield torn(data)
        if unsure:
            yield from map(torn, unsure if held is None else [held, *unsure])
        else:
            yield from closed()


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below `path`, in columns RECORDS."""
    pieces = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    pieces = pieces.select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start")
    fields = [*_FIELDS, *_PLACE]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def run(batches):
        rows, size = [], 0
        for row in _split_records((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), payloads):
            rows.append(row)
            size += len(row[6] or b"") + len(row[-1] or b"")
            if len(rows) >= 2000 or size > 8 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    found = written(map_batches(pieces, run, f"{RECORDS}, {FRAGMENTS}"), "records")

    def repair(table: pa.Table) -> pa.Table:
        """A file's fragments in order: a record's beginning and what other ranges found of it."""
        rows, held = [], None
        ordered = sorted(zip(*(table.column(n).to_pylist() for n in ("block", "seq", "fragment")), strict=True))
        for begins, data in [*_judged(d for _, _, d in ordered), (True, None)]:
            if not begins:
                held = None if held is None else held + data
                continue
            if held is not None:
                whole = _inflate(held)
                if whole is None:
                    raise ValueError("an archive ends within a record")
                page = page_of(whole)
                rows.append(page if payloads else (*page[:6], None))
            held = data
        columns = zip(*rows, strict=True) if rows else [[] for _ in _FIELDS]
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    whole = found.where(F.col("fragment").isNull()).select(*(n for n, _ in _FIELDS))
    torn = found.where(F.col("fragment").isNotNull())
    files = torn.select("path").distinct().count()  # a footer tells of most parts that they have none
    if not files:
        return whole
    few = torn.repartition(min(files, TORN_TASKS), "path").groupBy("path").applyInArrow(repair, RECORDS)
    return whole.unionByName(few)
