"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing: one record per row. Rows with equal payloads share one response record; the others are revisits of it.

Reading: the files are read by splits at every ``WARC/1.``, so each piece between two of these that goes on with ``0\\r\\n`` or
``1\\r\\n`` is a candidate record (versions 1.0 and 1.1).
Each task gives its candidates' offsets and those of their successors (from Content-Length). A magic inside a payload
gives a false candidate. Within a split each candidate's chain is followed to where it leaves the split; between splits
pointer jumping from the files' starts keeps only the reachable entries; then each split marks what its reachable
entries reach. What no chain from a file's start reaches is payload, and is joined to its record again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, remove, scratch, table, written

MAGIC = "WARC/1."
VERSION = "1\r\n"
EOL = "\r\n"
DATE = "1970-01-01T00:00:00Z"
URN = "urn:page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, by built-in functions."""
    digest = F.upper(F.sha1(payload))
    fives = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Writes a record for every row of pages to WARC files below path.

    Of rows whose payloads are equal and of at least min_bytes bytes, that with the largest id is a response and the others
    are revisits of it; shorter ones are all responses. Null payload: empty. Null id: the smallest of all, its record has
    the id ``null``; where a group has only null ids all are responses, as are repeated rows of the largest id. Null url: empty;
    line ends in a url become spaces. Other columns are left out. No rows: no records.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"),
    )
    body = F.col("body").cast("binary")
    keyed = rows.select("id", base32_sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes)
    winners = keyed.groupBy("digest", "n").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # Only revisits go into the join with the payloads: few of them are broadcast, many are shuffled.
    revisits, _ = written(
        keyed.join(winners, ["digest", "n"]).where("id is null and winner is not null or id < winner").select(
            F.col("id").alias("rid"), "digest", "winner"
        ).distinct(),
        "revisits",
    )
    own = rows.withColumn("own", base32_sha1(body)).withColumn("n", F.octet_length(body))
    full = own.join(revisits, F.col("id").eqNullSafe(F.col("rid")) & (F.col("own") == F.col("digest")), "left")
    head = F.concat(F.lit(HTTP), F.lit("Content-Length: "), F.col("n").cast("string"), F.lit(EOL + EOL))
    is_revisit = F.col("digest").isNotNull()
    block = F.when(is_revisit, head).otherwise(F.concat(head, F.col("body")))
    name = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC + VERSION + "WARC-Type: "),
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(EOL + "WARC-Record-ID: "),
        name(F.col("id")),
        F.lit(EOL + "WARC-Target-URI: "),
        F.col("url"),
        F.lit(f"{EOL}WARC-Date: {DATE}{EOL}WARC-Payload-Digest: sha1:"),
        F.col("own"),
        F.lit(EOL + "WARC-Payload-Length: "),
        F.col("n").cast("string"),
        F.when(is_revisit, F.concat(F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), name(F.col("winner")))).otherwise(F.lit("")),
        F.lit(EOL + "Content-Type: application/http; msgtype=response" + EOL + "Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(EOL + EOL),
        block,
        F.lit(EOL),
    )
    full.select(record.alias("value")).write.option("lineSep", EOL).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magics of the files, in order: file, block (start of the split), seq in the split, value (bytes)."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value"),
    )


def _header(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per piece: its length, where its header ends, its fields, and its payload's digest if the whole is in it."""
    pieces = _pieces(spark, path).withColumn("head", F.substring_index("value", EOL + EOL, 1))
    raw = F.col("value").cast("binary")
    pieces = pieces.select(
        "file",
        "block",
        "seq",
        "value",
        F.octet_length("value").cast("long").alias("len"),
        (F.octet_length("head") + 4).cast("long").alias("body_at"),
        F.col("value").rlike(r"\A[01]\r\n").alias("versioned"),
        _header("Content-Length").try_cast("long").alias("content"),
        F.lower(_header("WARC-Type")).alias("record_type"),
        _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Refers-To").alias("refers"),
        _header("WARC-Target-URI").alias("url"),
        _header("WARC-Payload-Digest").alias("named"),
        _header("WARC-Payload-Length").try_cast("long").alias("named_bytes"),
    )
    block = F.substring(raw, F.col("body_at").cast("int") + 1, F.col("content").cast("int"))
    whole = F.col("content").isNotNull() & (F.col("len") >= F.col("body_at") + F.col("content"))
    payload = _payload(block)
    return pieces.select(
        *[c for c in pieces.columns if c != "value"],
        whole.alias("whole"),
        F.when(whole, base32_sha1(payload)).alias("digest"),
        F.when(whole, F.octet_length(payload)).cast("long").alias("bytes"),
    )


def _payload(block: Column) -> Column:
    """An HTTP message's body; its head (ASCII) ends at the first empty line."""
    head = F.substring_index(block.cast("string"), EOL + EOL, 1)
    return F.substring(block, F.octet_length(head) + 5, 2147483647)


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds off, the offset of each piece's magic: running lengths within the split, then over splits."""
    n = len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum(F.col("len") + n).over(inside), F.lit(0)))
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("len") + n).alias("span"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("span").over(over), F.lit(0)).alias("from"))
    return pieces.join(blocks, ["file", "block"]).withColumn("off", F.col("from") + F.col("before") - n).drop("before", "from")


def _located(cands: DataFrame) -> DataFrame:
    """Adds off (offset of the candidate's magic) and nxt (that of its successor)."""
    return _placed(cands).withColumn("nxt", F.col("off") + len(MAGIC) + F.col("body_at") + F.col("content") + 4)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of one split, where its chain leaves the split (null: at no record)."""
    pdf = pdf.sort_values("off")
    exits: dict[int, int | None] = {}
    for off, nxt in zip(pdf["off"].to_numpy()[::-1], pdf["nxt"].to_numpy()[::-1], strict=True):
        exits[int(off)] = None if pd.isna(nxt) else exits.get(int(nxt), int(nxt))
    keys = list(exits)
    return pd.DataFrame({"file": pdf["file"].iloc[0], "off": keys, "nxt": pd.array([exits[k] for k in keys], dtype="Int64")})


def _marked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The split's candidates that its reachable entries reach."""
    if left.empty:
        return left.iloc[:0][["file", "block", "seq", "off", "nxt"]]
    left = left.sort_values("off")
    live = set(right["off"].tolist())
    keep = []
    for off, nxt in zip(left["off"].tolist(), left["nxt"].tolist(), strict=True):
        keep.append(off in live)
        if keep[-1] and not pd.isna(nxt):
            live.add(int(nxt))
    return left[keep][["file", "block", "seq", "off", "nxt"]]


def _reachable(located: DataFrame) -> DataFrame:
    """Chain verification: (file, block, seq, off, nxt) of the true records."""
    spark = located.sparkSession
    slim = located.where("off >= 0 and versioned and record_type <> '' and content >= 0").select("file", "block", "seq", "off", "nxt")
    chains = slim.groupBy("file", "block").applyInPandas(_exits, "file string, off long, nxt long")
    chains, chains_at = written(chains, "chains")
    starts = chains.groupBy("file").agg(F.min("off").alias("off")).where("off = 0")
    # Nodes between splits: where files start and where chains leave a split.
    nodes = starts.unionByName(chains.select("file", F.col("nxt").alias("off")).where("off is not null").distinct()).distinct()
    edges = cut(chains.join(nodes, ["file", "off"], "left_semi"))
    reach, known = cut(starts), -1
    while (count := reach.count()) != known:
        known = count
        step = edges.join(reach, ["file", "off"], "left_semi").where("nxt is not null").select("file", F.col("nxt").alias("off"))
        reach = cut(reach.unionByName(step).distinct())
        jump = edges.select("file", F.col("off").alias("nxt"), F.col("nxt").alias("far"))
        edges = cut(edges.join(jump, ["file", "nxt"], "left").select("file", "off", F.col("far").alias("nxt")).unionByName(edges).where("nxt is not null").distinct())
    entries = slim.join(reach, ["file", "off"], "left_semi").select("file", "block", "off").toDF("in_file", "in_block", "off")
    out = slim.groupBy("file", "block").cogroup(entries.groupBy("in_file", "in_block")).applyInPandas(
        _marked, "file string, block long, seq long, off long, nxt long"
    )
    out = cut(out)
    remove(spark, chains_at)
    return out


def _complete(located: DataFrame, true: DataFrame) -> None:
    """Raises where the chain of a file's records ends before the file does (its last record may lack the empty lines after it)."""
    n = len(MAGIC)
    ends = located.groupBy("file").agg(F.max(F.col("off") + n + F.col("len")).alias("size")).where("size > 0")
    last = true.groupBy("file").agg(F.max("nxt").alias("upto"))
    short = ends.join(last, "file", "left").where("upto is null or upto < size or upto > size + 4").orderBy("file").limit(5).collect()
    if short:
        raise RuntimeError("; ".join(f"the records of {r.file} end at byte {r.upto or 0} of {r.size}" for r in short))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files (1.0 and 1.1, uncompressed) below path: record_id, record_type, refers, url, bytes, digest (of the
    full payload; for revisits as their headers name it).

    A payload may hold magics and whole records: they are no records. A payload of any length is put together in one row. Rows come in no
    order; equal records all stay. A file whose chain of records ends before the file (a wrong length, a torn file) stops the query
    with the offset. Empty files: no rows.
    """
    cands, at = written(_candidates(spark, path), "candidates")
    located, located_at = written(_located(cands), "located")
    remove(spark, at)
    true = _reachable(located)
    _complete(located, true)
    records = located.drop("off", "nxt").join(true, ["file", "block", "seq"])
    single = records.where("whole")
    broken = records.where("not whole")
    fields = ["record_id", "record_type", "refers", "url", "named", "named_bytes", "bytes", "digest"]
    out = single.select(*fields)
    if broken.limit(1).count():
        out = out.unionByName(_rejoined(spark, path, broken).select(*fields))
    revisit = F.col("record_type") == "revisit"
    named = F.regexp_replace("named", "^sha1:", "")
    ok = revisit | (F.col("named") == "") | (F.col("digest") == named)
    return out.select(
        "record_id",
        "record_type",
        "refers",
        "url",
        F.when(revisit, F.col("named_bytes")).otherwise(F.col("bytes")).alias("bytes"),
        F.when(~ok, F.raise_error(F.lit("payload digest differs"))).when(revisit, named).otherwise(F.col("digest")).alias("digest"),
    )


def _rejoined(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """Records whose payload holds magics: their pieces are put together again, by record.

    The files that have such records are read once more. That read may be split otherwise, so pieces go by their offsets.
    """
    pieces = _pieces(spark, path).join(broken.select("file").distinct(), "file", "left_semi")
    pieces, _ = written(pieces.withColumn("len", F.octet_length("value").cast("long")), "pieces")
    owners = broken.select("file", F.col("off").alias("own"), F.col("nxt").alias("upto"))
    places = _placed(pieces.select("file", "block", "seq", "len")).where("off >= 0")
    # The last broken record at or before a piece, in its split or in the splits before.
    tagged = places.join(owners, (places["file"] == owners["file"]) & (places["off"] == owners["own"]), "left").select(
        places["file"], "block", "seq", "off", F.last("own", True).over(Window.partitionBy(places["file"], "block").orderBy("off")).alias("own")
    )
    ends = tagged.groupBy("file", "block").agg(F.max("own").alias("last_own"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last("last_own", True).over(before).alias("carried"))
    tagged = tagged.join(ends, ["file", "block"]).select("file", "block", "seq", "off", F.coalesce("own", "carried").alias("own"))
    parts = tagged.join(owners, ["file", "own"]).where("off < upto").select("file", "block", "seq", "off", "own")
    texts = pieces.join(parts, ["file", "block", "seq"])
    whole = texts.groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("off", F.col("value").cast("string").alias("value")))).alias("p"))
    whole = whole.select("file", F.col("own").alias("off"), F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).cast("binary").alias("raw"))
    back = broken.drop("digest", "bytes").join(whole, ["file", "off"])
    block = F.substring(F.col("raw"), F.col("body_at").cast("int") + 1, F.col("content").cast("int"))
    payload = _payload(block)
    return back.withColumn("digest", base32_sha1(payload)).withColumn("bytes", F.octet_length(payload).cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, rf"^<{URN}(-?\d+)>$", 1).try_cast("long")
    return read_warc(spark, path).select(
        number("record_id").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        number("refers").alias("refers_to"),
    )
