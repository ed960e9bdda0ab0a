"""Operator 5 - media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of structs, each a text or a reference to media, with the caption of its figure. A
reference ``sha256:...`` names a payload by the SHA-256 digest of its stored form; another is kept as ``src`` and has no
digest. References are resolved by a join on the digest, so a payload is described once however many documents refer to it;
position and caption stay with the reference. Digests that many references share are split over tasks.

Payloads are stored as PNG images of 8-bit gray samples, ``ROW`` samples a line, and read back from there. Each document's
payload is stored where the document lies: storing equal ones once would shuffle all texts, which costs more disk than copies do.

Defined results: a null page has no items; an unknown digest resolves to null; a text is trimmed and empty texts are left
out; a caption belongs to all media of its figure; media outside a figure have their ``alt`` text, or null, as caption; media
without ``src`` are named by the first address of ``srcset``, else left out. A null text is the empty text, long texts are taken
whole, repeated rows give repeated rows, an empty table gives none, and only the named columns are read.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

ROW = 192
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("src", pa.string()), ("caption", pa.string())])
_BREAKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "article", "section", "figure", "figcaption", "ul", "ol", "table", "blockquote", "pre", "title", "nav", "header", "footer"}


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None
        self.hidden = 0

    def flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "src": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in ("img", "audio", "video", "source"):
            a = dict(attrs)
            src = (a.get("src") or "").strip() or " ".join((a.get("srcset") or "").split(",")[0].split()[:1])
            if src:
                self.flush()
                known = src.startswith("sha256:")
                self.items.append({"kind": "media", "text": None, "digest": src.removeprefix("sha256:") if known else None, "src": None if known else src, "caption": a.get("alt")})
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)
        elif tag in _BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "figcaption" and self.caption is not None:
            said, self.caption = "".join(self.caption).strip(), None
            for i in self.figure or []:
                self.items[i]["caption"] = said or self.items[i]["caption"]
        elif tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        (self.buffer if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """The ordered items of an HTML page."""
    if not page:
        return []
    parser = _Parser()
    parser.feed(page)
    parser.close()
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``key`` and ``items``: an array of structs (position, kind, text, digest, caption) in the page's order."""
    kind = pages.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.row_chunks(whole, column):
                items = [parse(x) for x in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(items, pa.list_(ITEM))], [key, "items"])

    return pages.select(key, column).mapInArrow(run, f"`{key}` {kind.simpleString()}, items array<struct<position:int,kind:string,text:string,digest:string,src:string,caption:string>>")


def resolve(seqs: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """One row a media reference: key, position, caption, src, digest and what ``media`` (a row a digest) has of it."""
    refs = seqs.select(F.col(key).alias("__key"), F.explode("items").alias("item")).where("item.kind = 'media'").select("__key", *(F.col(f"item.{c}").alias(c) for c in ("position", "caption", "src", "digest")))
    heavy = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > base.HEAVY)
    found = base.split_join(refs, media, ["digest"], heavy, ["__key", "position"], "left")
    return found.withColumnRenamed("__key", key)


def with_payloads(seqs: DataFrame, store: DataFrame, key: str = "page_id", payload: str = "payload") -> DataFrame:
    """``key`` and ``items`` in their order, each media item with the bytes that ``store`` (digest, payload) has for its digest.

    A page is what shares a row of ``seqs``: rows of one key stay apart. Texts, positions and captions are as they were; a digest
    that ``store`` lacks, or that does not name the bytes it has, gives null. Bytes are joined to references by digest, those
    that many references share over several tasks, and come together again by page: a page and its media fit a task.
    """
    names = ["position", "kind", "text", "digest", "src", "caption"]
    pages = base.stored(seqs.select(F.monotonically_increasing_id().alias("page"), F.col(key).alias("of"), "items"), "pages")  # a page's number is fixed once written
    refs = pages.select("page", F.explode("items").alias("item")).where("item.digest is not null").select("page", F.col("item.position").alias("position"), F.col("item.digest").alias("digest"))
    sound = store.where(F.sha2(payload, 256) == F.col("digest")).groupBy("digest").agg(F.first(payload).alias("payload"))
    heavy = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > base.HEAVY)
    found = base.split_join(refs, sound, ["digest"], heavy, ["page", "position"])
    held = found.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("position", "payload"))).alias("held"))  # a page's own references
    both = pages.join(held, "page", "left")
    items = F.transform("items", lambda x: F.struct(*(x[n].alias(n) for n in names), F.try_element_at("held", x["position"]).alias("payload")))
    return both.select(F.col("of").alias(key), items.alias("items"))


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def padded(text: str) -> bytes:
    """UTF-8 bytes, spaces appended to a positive multiple of ``ROW``."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def to_png(payload: bytes) -> bytes:
    """A gray 8-bit image with the payload as its samples, row by row."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that :func:`to_png` wrote; checksums and sizes are verified."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, idat, size = 8, [], None
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if name == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif name == b"IDAT":
            idat.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that is not stored here")
    return lines[:, 1:].tobytes()


def describe(samples: bytes) -> str:
    """Mean, deviation and histogram (16 bins of the sample's value) of an image, as text."""
    x = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, v = x.sum(), np.arange(256)
    mean = float(x @ v / n)
    return f"{mean:.4f};{float(np.sqrt(max(0.0, x @ (v * v) / n - mean * mean))):.4f};" + ",".join(map(str, x.reshape(16, 16).sum(1)))


STORED = "doc_id long, n_bytes long, items array<struct<position:int,kind:string,text:string,digest:string,src:string,caption:string>>, media binary"
MEDIA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def page_of(text: str, png: bytes) -> str:
    """A page that shows a text and, in a figure, refers to its stored form."""
    return f'<article><p>{html.escape(text, quote=False)}</p><figure><img src="sha256:{hashlib.sha256(png).hexdigest()}"><figcaption>payload</figcaption></figure></article>'


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Each document's stored form, and the items of its page; the text items' text is not stored a second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.row_chunks(whole):
                items, stored, sizes = [], [], []
                for text in base.texts_of(batch):
                    stored.append(to_png(padded(text)))
                    sizes.append(len(text.encode("utf-8", "surrogatepass")))
                    items.append([x | {"text": None} for x in parse(page_of(text, stored[-1]))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(items, pa.list_(ITEM)), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "items", "media"])

    return base.id_text(docs).mapInArrow(run, STORED)


def media_table(stored: DataFrame) -> DataFrame:
    """A row a distinct stored form of column ``media``, read from its bytes: digest, sizes, digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
        for batch in batches:
            rows = []
            for data in batch.column("media"):
                png = data.as_py()
                samples = from_png(png)
                rows.append((hashlib.sha256(png).hexdigest(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(png), describe(samples)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    table = stored.select("media").mapInArrow(run, MEDIA)
    return table.groupBy("digest").agg(*(F.first(c).alias(c) for c in table.columns[1:]))


def document_media(docs: DataFrame) -> DataFrame:
    """Store every document's padded text as media, read it back, and give each document the features of its media.

    Only digests, captions and features are shuffled; the stored bytes are read where they lie.
    """
    spark = docs.sparkSession
    out = base.shared_path(spark, "media")
    documents_as_media(docs).write.parquet(out)
    kept = spark.read.schema(STORED).parquet(out)
    named = kept.select(F.struct("doc_id", "n_bytes").alias("of"), "items")
    found = resolve(named, media_table(kept), "of")
    return found.select("of.doc_id", "of.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "caption")
