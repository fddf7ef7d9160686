"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs: runs of text, and references to media with their captions. A media
payload is stored once a digest and task, as an 8-bit grey image (binary PGM, WIDTH samples a row, the payload's bytes
followed by zero bytes to whole rows), beside its digest. A join on the digest resolves the references; each
resolved struct keeps its position in the sequence and its caption.

Payloads never move: what the join shuffles is a payload's features, computed where its stored bytes are read, and the
digests. A digest may stand in a third of all references: those that have over a thousandth of them (at most 1000) go by
a broadcast, the others by a shuffle join.

An element left open ends where the element around it ends: so do captions, and skipped elements (scripts, styles, templates); a
skipped element that nothing around it ends is read as if its tag weren't there. A figure within a figure ends the outer one's
captioning. A figure with several captions has the last; a caption without media is text.

A null text or HTML gives an empty payload or sequence, an empty table empty ones. Texts and pages of any length are read whole. A
reference whose digest isn't stored keeps its place with null features. Equal payloads have equal values, whatever their row; repeated
rows of a page, and pages of one key with different HTML, keep their own sequences. `interleave` replaces a column _row of its
input; other columns pass through or, where a function names what it reads, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WIDTH = 64
SCHEME = "media:sha256/"
_SKIPPED = {"script", "style", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_MEDIA = {"img", "audio", "video", "source", "embed"}
_BREAKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "ul", "ol", "article", "section", "nav", "header", "footer", "figure", "figcaption", "blockquote", "pre", "title"}

ITEM = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("caption", T.StringType()),
])


class _Parser(HTMLParser):
    """Items in document order. A figure's caption goes to its media, wherever in the figure it stands; without one the alternative text is the caption.

    Open elements stand on a stack; the end of one ends those within it. shown: the numbers (by start tags) of skipped elements that are read after all."""

    def __init__(self, shown: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.open: list[tuple[str, int]] = []
        self.depth: dict[str, int] = {}
        self.tags = self.skip = 0
        self.shown = shown
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None
        self.title: str | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "src": None, "caption": None})

    def close_caption(self) -> None:
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figure is not None:
            self.title = text or self.title
        elif text:
            self.run.append(text)
            self.flush()

    def close_figure(self) -> None:
        """Gives the figure's caption to its media; without media it is text."""
        self.close_caption()
        for i in self.figure or ():
            self.items[i]["caption"] = self.title or self.items[i]["caption"]
        if not self.figure and self.title:
            self.flush()
            self.run.append(self.title)
            self.flush()
        self.figure = self.title = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in _VOID:
            self.open.append((tag, self.tags))
            self.depth[tag] = self.depth.get(tag, 0) + 1
        if tag in _SKIPPED and self.tags not in self.shown:
            self.skip += 1
        if self.skip:
            return
        if tag in _BREAKS and self.caption is None:
            self.flush()
        if tag == "figure":
            self.close_figure()
            self.figure = []
        if tag == "figcaption":
            self.close_caption()
            self.caption = []
        at = dict(attrs)
        if tag in _MEDIA and at.get("src"):
            self.flush()
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "src": at["src"], "caption": at.get("alt") or at.get("title")})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _SKIPPED:  # elsewhere the stroke means nothing
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.depth.get(tag):
            return
        while True:
            name, number = self.open.pop()
            self.depth[name] -= 1
            if name in _SKIPPED and number not in self.shown:
                self.skip -= 1
            elif not self.skip:
                if name == "figcaption":
                    self.close_caption()
                if name == "figure" and self.figure is not None:
                    self.close_figure()
                if name in _BREAKS and self.caption is None:
                    self.flush()
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    shown: frozenset[int] = frozenset()
    while True:
        parser = _Parser(shown)
        parser.feed(html or "")
        parser.close()
        # At the end only skipped elements that nothing ended are still open; scripts and styles hold no elements.
        left = frozenset(k for name, k in parser.open if name in _SKIPPED - {"script", "style"}) - shown
        if not left:
            parser.close_figure()
            parser.flush()
            return parser.items
        shown |= left


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and items, the ordered sequence of each page."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x) for x in b.column(1).to_pylist()], kind)], names=[key, "items"])

    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("caption", pa.string())]))
    return pages.select(key, html).mapInArrow(batches, T.StructType([pages.schema[key], T.StructField("items", T.ArrayType(ITEM))]))


# ---- payloads -------------------------------------------------------------------------------


def to_media(payload: bytes) -> bytes:
    """A payload as a PGM image of WIDTH columns; its length is a multiple of WIDTH."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(stored: bytes) -> np.ndarray:
    """The samples of a stored image, a row each."""
    magic, size, most, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a grey image of 8 bits")
    return np.frombuffer(samples, dtype=np.uint8).reshape(height, width)


def feature(samples: np.ndarray) -> str:
    """Rows, the mean sample in thousandths, a 16-step histogram in thousandths, and which columns are brighter than all on average (a bit each)."""
    flat = samples.ravel()
    histogram = np.bincount(flat >> 4, minlength=16) * 1000 // len(flat)
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = np.packbits(columns * len(columns) > columns.sum()).tobytes().hex()
    return f"{samples.shape[0]}|{int(flat.sum(dtype=np.int64)) * 1000 // len(flat)}|{','.join(map(str, histogram))}|{bits}"


def payload_of(text: Column) -> Column:
    """UTF-8 bytes with zero bytes up to a positive multiple of WIDTH."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)).cast("int") * WIDTH
    return F.rpad(raw, size, F.lit(b"\0"))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_media(payloads: DataFrame, digest: str, payload: str) -> DataFrame:
    """Stores payloads as images, once a digest and Arrow batch, and returns the store: digest, n (how many had it) and media."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = b.column(0).to_pylist()
            count: dict[str, list[int]] = {}
            for i, k in enumerate(keys):
                count.setdefault(k, [i, 0])[1] += 1
            raw = b.column(1)
            media = [to_media(raw[i].as_py()) for i, _ in count.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array([n for _, n in count.values()], pa.int64()), pa.array(media, pa.binary())], names=["digest", "n", "media"])

    store = payloads.select(digest, payload).mapInArrow(batches, "digest string, n long, media binary")
    return C.store(store, "media")[0]


def features(store: DataFrame) -> DataFrame:
    """digest, n and the features of each stored payload, from its stored bytes; a digest has one row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for stored in b.column(2):
                stored = stored.as_py()
                samples = from_media(stored)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    names = ["digest", "n", *(x.split()[0] for x in FEATURES.split(", "))]
    rows = store.select("digest", "n", "media").mapInArrow(batches, f"digest string, n long, {FEATURES}")
    return rows.groupBy("digest").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in names[2:]))


NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def resolve(pages: DataFrame, key: list[str], media: DataFrame) -> DataFrame:
    """A row for each media reference of the sequences (key, items): its position, caption, digest and the features of its payload. Rows
    that agree in key, position, caption and digest are one, with their number n_rows."""
    digest = F.when(F.col("item.src").startswith(SCHEME), F.substring("item.src", len(SCHEME) + 1, 64)).alias("digest")
    refs = pages.select(*key, F.explode("items").alias("item")).filter("item.kind = 'media'").select(*key, "item.position", "item.caption", digest)
    weights = refs.filter("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("w"))
    refs = refs.groupBy(*key, "position", "caption", "digest").agg(F.count(F.lit(1)).alias("n_rows"))
    total = pages.select(F.coalesce(F.sum(F.size(F.filter("items", lambda x: x["kind"] == "media"))), F.lit(0))).first()[0]
    return C.join_on_unique(refs, media.join(weights, "digest"), ["digest"], "w", total).drop("w")


def interleave(pages: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """The sequences with their media resolved in place: items gain media, a struct of digest and features; order, captions and
    unresolved references stay. pages (key, items) is read several times, so it should be stored."""
    # A struct equals another where both have null, so pages without a key find their media too.
    row = pages.withColumn("_row", F.struct(F.col(key).alias("key"), F.xxhash64(F.to_json(F.struct("items"))).alias("hash")))
    found = resolve(row, ["_row"], media)
    entry = F.struct("position", F.struct("digest", *NAMES))
    # Equal hashes of different sequences would give two entries of a position, so the map keeps the first of each.
    entries = F.array_sort(F.collect_list(entry))
    found = found.groupBy("_row").agg(F.max("n_rows").alias("n_rows"), F.map_from_entries(F.filter(entries, lambda x, i: (i == 0) | (F.element_at(entries, F.greatest(i, F.lit(1)))["position"] != x["position"]))).alias("_media"))
    joined = C.join_on_unique(row, found, ["_row"], "n_rows", pages.count())
    return joined.withColumn("items", F.transform("items", lambda x: x.withField("media", F.try_element_at("_media", x["position"])))).drop("_media", "_row", "n_rows")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's page has text, a mark that all pages share, the whole payload as a captioned figure and more text; both media come
    back through the page's interleaved sequence. The mark's payload is that of an empty text."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = docs.withColumn("payload", payload_of(F.col("text"))).withColumn("digest", F.sha2("payload", 256))
    mark = spark.range(1).select(payload_of(F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    media, _ = C.store(features(stored_media(made.select("digest", "payload").unionByName(mark), "digest", "payload")), "media-features")
    n_bytes = F.octet_length(F.coalesce("text", F.lit("")))
    image = lambda digest, more="": F.concat(F.lit(f'<img {more}src="{SCHEME}'), digest, F.lit('">'))
    mark_digest = F.lit(hashlib.sha256(bytes(WIDTH)).hexdigest())
    parts = [F.lit("<article><h1>Document</h1>"), image(mark_digest, 'alt="mark" '), F.lit("<p>Its text:</p><figure><figcaption>"), n_bytes.cast("string"), F.lit(" bytes</figcaption>"), image(F.col("digest")), F.lit("</figure><p>So it ends.</p></article>")]
    pages = made.select(F.struct("doc_id", n_bytes.cast("long").alias("n_bytes")).alias("page"), F.concat(*parts).alias("html"))
    pages, _ = C.store(sequences(pages, "page"), "sequences")
    seen = interleave(pages, "page", media).withColumn("shown", F.filter("items", lambda x: x["kind"] == "media")).withColumn("whole", F.col("shown")[1])
    outline = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["position"], x["kind"], F.coalesce(x["text"], x["caption"]), x["media"]["payload_bytes"])), "|")
    return seen.select("page.doc_id", "page.n_bytes", *(F.col(f"whole.media.{c}").alias(c) for c in NAMES), F.col("whole.position").alias("position"), F.col("whole.caption").alias("caption"), outline.alias("sequence"))
