"""Files as tables: Markdown records, JSON manifests, export folders; and the sinks that write them."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import ids, text, urls
from quern.operators.assets import package_faults, running_total
from quern.operators.records import markdown

_FRONT = T.StructType([T.StructField(k, T.StringType()) for k in ("platform", "source_url", "title", "author", "date", "scraped_at", "content_hash")])


@F.pandas_udf(_FRONT)
def front_matter(block: pd.Series) -> pd.DataFrame:
    """Known fields of YAML front matter, as text; all null where it is no mapping."""
    import yaml

    def one(b: str | None) -> list:
        try:
            m = yaml.safe_load(b or "")
        except yaml.YAMLError:
            m = None
        m = m if isinstance(m, dict) else {}
        return [None if m.get(k) is None else str(m[k]) for k in _FRONT.names]

    return pd.DataFrame([one(b) for b in block], columns=_FRONT.names)


def read_markdown(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(path, platform ... content_hash, body, fault) of all Markdown records under a folder; with ``strict`` a faulty one is an error.

    ``fault`` tells why a record can't be used: no front matter, no mapping, no source URL, or a body that no longer has its hash.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    raw = raw.where(~F.col("path").contains("/_provenance/")).select("path", F.decode("content", "UTF-8").alias("t"))
    parts = raw.withColumn("p", F.split("t", "---", 3))
    d = parts.select("path", front_matter(F.get("p", 1)).alias("m"), F.regexp_replace(F.coalesce(F.get("p", 2), F.lit("")), r"^\n+", "").alias("rest"), (F.size("p") == 3).alias("whole")).select("path", "m.*", "rest", "whole")
    heading = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"))
    body = text.strip(F.when((F.coalesce("title", F.lit("")) != "") & F.startswith("rest", heading), F.substring("rest", F.length(heading) + 1, F.length("rest"))).otherwise(F.col("rest")))
    d = d.withColumn("body", body)
    fault = F.when(~F.col("whole"), "no-front-matter").when(F.col("platform").isNull(), "no-mapping").when(F.coalesce("source_url", F.lit("")) == "", "no-source-url").when(~F.col("content_hash").eqNullSafe(F.sha2("body", 256)), "content-hash")
    d = d.withColumn("fault", fault).drop("rest", "whole")
    return d if not strict else d.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "fault")).cast("string")))


def write_markdown(records: DataFrame, folder: str) -> None:
    """Written records (platform, path, ...) as one text file each, by the executors."""
    from pyspark import TaskContext

    rows = records.select("path", markdown(records).alias("doc"))

    def put(batches):
        import os

        import pyarrow.fs as pafs

        base = folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)
        fs, root = pafs.FileSystem.from_uri(base)
        part = f".part-{TaskContext.get().taskAttemptId()}"
        n = 0
        for b in batches:
            for path, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = f"{root}/{path}"
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at + part) as f:
                    f.write(doc.encode())
                fs.move(at + part, at)  # whole or not at all; a second attempt writes the same bytes
                n += 1
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one row


_ASSET = "asset_id string, record_path string, local_path string, sha256 string, bytes bigint, mime string, modality string, title string, source_url string, access_class string, local_only boolean, metadata map<string,string>, tombstoned_at string"
_PORTABLE = "contract string, assets array<struct<asset_id string, relative_path string, sha256 string, byte_size bigint, media_type string, role string, alt string, source_url string, source_policy struct<access_class string, local_only boolean>>>"


def read_manifests(spark: SparkSession, jsonl: str | None = None, portable: str | None = None) -> DataFrame:
    """Asset rows of a JSON-lines manifest and of a portable one (contract provenance-assets.v1), one after the other; a portable one of another contract is an error."""
    names = [f.name for f in T.StructType.fromDDL(_ASSET).fields]
    out = []
    if jsonl is not None:
        out.append(spark.read.schema(_ASSET).json(jsonl).withColumns({"local_only": F.coalesce("local_only", F.lit(True)), "mime": F.coalesce("mime", text.mime_of("local_path"))}))
    if portable is not None:
        raw = spark.read.schema(_PORTABLE).option("multiLine", True).json(portable)
        wrong = ~F.col("contract").eqNullSafe(F.lit("provenance-assets.v1"))
        a = raw.select(F.explode(F.when(wrong, F.raise_error(F.lit(f"{portable}: unsupported contract")).cast(raw.schema["assets"].dataType)).otherwise(F.col("assets"))).alias("a")).select("a.*")
        mime = F.coalesce("media_type", F.lit("application/octet-stream"))
        kind = F.when(F.col("role").isin("text", "document", "image", "audio", "video"), F.col("role")).otherwise(text.modality_of(mime))
        meta = F.create_map(F.lit("alt"), F.coalesce("alt", F.lit("")), F.lit("role"), F.coalesce("role", F.lit("source")))
        out.append(a.select("asset_id", F.col("relative_path").alias("record_path"), F.col("relative_path").alias("local_path"), "sha256", F.col("byte_size").alias("bytes"), mime.alias("mime"), kind.alias("modality"), F.coalesce(F.nullif("alt", F.lit("")), "asset_id").alias("title"), "source_url", F.coalesce("source_policy.access_class", F.lit("unknown")).alias("access_class"), F.coalesce("source_policy.local_only", F.lit(True)).alias("local_only"), meta.alias("metadata"), F.lit(None).cast("string").alias("tombstoned_at")))
    if not out:
        return spark.createDataFrame([], _ASSET)
    first = out[0].select(names)
    return first.unionByName(out[1].select(names)) if len(out) > 1 else first


def manifest_faults(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(asset_id, fault) of manifest rows against files (path, content)."""
    real = files.select(F.col("path").alias("local_path"), F.sha2("content", 256).alias("real"), F.length("content").cast("long").alias("size"))
    j = rows.join(real, "local_path", "left")
    checks = [("asset-id", ~ids.opaque_id_ok("asset_id")), ("path", ~ids.relative_path_ok("local_path")), ("missing", F.col("real").isNull()), ("digest", F.col("real") != F.col("sha256")), ("size", F.col("size") != F.col("bytes")), ("modality", ~F.col("modality").isin("text", "document", "image", "audio", "video"))]
    return j.select("asset_id", F.explode(F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in checks)), lambda x: x.isNotNull())).alias("fault"))


def discover_export(spark: SparkSession, folder: str, overrides: DataFrame | None = None, max_item_bytes: int = 100 << 20, max_total_bytes: int = 2 << 30, max_items: int = 1000) -> DataFrame:
    """Items of an export folder by path: media type, modality, digest, size, title, id, and a ``fault`` where one may not be taken in.

    Dot files and unknown types are left out. Session folders, oversize items, and what comes after the package's caps are faults. ``overrides`` (path, title,
    source_url, item_id, transcript_path) replace what is derived.
    """
    root = folder.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring_index("path", f"{root.removeprefix('file://')}/", -1).alias("path")
    # the listing reads no contents, and the scan of contents skips files by their length
    d = raw.select(rel, F.col("length").alias("byte_size")).where(~F.col("path").rlike(r"(^|/)\.")).withColumn("mime", text.mime_of("path")).where("mime <> 'application/octet-stream'")
    read = raw.where(F.col("length") <= max_item_bytes).select(rel, F.sha2("content", 256).alias("sha256"), F.decode("content", "ISO-8859-1").alias("c"))
    read = read.select("path", "sha256", (text.modality_of(text.mime_of("path")).isin("text") & (F.size(text.secret_kinds("c")) > 0)).alias("secret"))
    d = running_total(d.withColumn("one", F.lit(1)).withColumn("package", F.lit(1)), "path", "byte_size", max_total_bytes, "package").withColumnRenamed("over", "too_large").drop("running")
    d = running_total(d, "path", "one", max_items, "package").withColumnRenamed("over", "too_many").join(read, "path", "left")
    session = F.size(text.secret_kinds("path")) > 0
    fault = F.when(session, "session-path").when(F.col("byte_size") > max_item_bytes, "item-size").when(F.col("too_large"), "total-size").when(F.col("too_many"), "item-count").when(F.col("secret"), "secret")
    d = d.select("path", text.modality_of("mime").alias("modality"), "mime", "sha256", "byte_size", fault.alias("fault"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "").alias("stem"))
    for c in ("title", "source_url", "item_id", "transcript_path"):
        d = d if overrides is not None and c in overrides.columns else d.withColumn(c, F.lit(None).cast("string"))
    if overrides is not None:
        d = d.join(overrides, "path", "left")
    return d.select("path", F.coalesce("item_id", ids.item_id("path")).alias("item_id"), "modality", "mime", F.coalesce("title", "stem").alias("title"), "sha256", "byte_size", urls.sanitize("source_url").alias("source_url"), "transcript_path", "fault")


_NAMES = ("contract", "package_id", "connector", "created_at", "source_policy", "items")
_POLICY = "source_policy struct<access_class string, rights_status string, local_only boolean, permitted_uses array<string>>"
_ITEM = "struct<item_id string, path string, sha256 string, byte_size bigint, mime string, modality string, title string, source_url string, transcript_path string, metadata map<string,string>>"
_PACKAGE = f"contract string, package_id string, connector string, created_at string, {_POLICY}, items array<{_ITEM}>"


def read_package(spark: SparkSession, path: str, max_manifest_bytes: int = 1 << 20, max_items: int = 1000) -> tuple[DataFrame, DataFrame]:
    """A package's manifest (one row), its items, as (package_id, ...), after its checks.

    Its size, secrets anywhere in it, fields that are missing, and the number of items are errors. What is wrong with items is for ``assets.package_faults``.
    """
    raw = spark.read.format("binaryFile").load(path)
    text_of = F.when(F.col("length") <= max_manifest_bytes, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit("manifest too large")).cast("string"))
    m = raw.select(text_of.alias("t")).select("t", text.json_secrets("t").alias("s"), F.from_json("t", _PACKAGE).alias("m")).select("s", "m.*")
    lacking = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull() if c in ("source_policy", "items") else F.coalesce(c, F.lit("")) == "", F.lit(c)) for c in _NAMES)), lambda x: x.isNotNull()), ", ")
    error = F.when(F.size("s") > 0, F.concat(F.lit("secret at "), F.get("s", 0)["place"])).when(lacking != "", F.concat(F.lit("missing: "), lacking)).when(F.size("items") > max_items, "too many items").when(~F.col("package_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), "package id")
    m = m.withColumn("package_id", F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(F.col("package_id"))).drop("s")
    return m, m.select("package_id", F.explode("items").alias("i")).select("package_id", "i.*")


def asset_manifest(assets: DataFrame) -> DataFrame:
    """One row, ``manifest``: the portable JSON of assets (asset_id, relative_path, sha256, byte_size, media_type, role, alt, source_url, source_policy) in order; a package bounds their number."""
    a = assets.agg(F.array_sort(F.collect_list(F.struct("asset_id", *sorted(c for c in assets.columns if c != "asset_id")))).alias("assets"))
    return a.select(F.to_json(F.struct("assets", F.lit("provenance-assets.v1").alias("contract")), {"ignoreNullFields": "false"}).alias("manifest"))


_STORED = "assets array<struct<asset_id string, relative_path string, sha256 string, byte_size bigint, media_type string, role string, alt string, source_url string, " + _POLICY + ", source_id string, item_id string>>"


def import_package(spark: SparkSession, manifest: str, folder: str, max_item_bytes: int = 100 << 20, max_total_bytes: int = 2 << 30, max_items: int = 1000) -> DataFrame:
    """Takes a package in, all or nothing, and returns its assets.

    Items must be contained files with the declared digest and size, within the bounds, and text without secrets. Blobs, assets.json, the manifest and a receipt are
    written beside the folder by executors and renamed into place; the folder must not be there.
    """
    import pyarrow as pa
    import pyarrow.fs as pafs

    m, items = read_package(spark, manifest, max_items=max_items)
    root = manifest.rpartition("/")[0]
    base = root if "://" in root or root.startswith("file:") else f"file://{root}"
    whole = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    aside = f"{whole.rstrip('/')}.import-{uuid.uuid4().hex}"
    rel = F.substring_index("path", f"{root.removeprefix('file://')}/", -1).alias("path")
    # only the declared files are read, and none beyond the bound
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") <= max_item_bytes).select(rel, "content")
    j = items.join(files, "path", "left").withColumn("real", F.sha2("content", 256))
    plain = F.lower("mime").rlike("^text/") | F.lower("mime").isin("application/json", "application/x-ndjson")
    secret = plain & (F.size(text.json_secrets(F.decode("content", "ISO-8859-1"))) > 0)
    fault = F.when(~ids.relative_path_ok("path"), "unsafe path").when(F.col("byte_size") > max_item_bytes, "item too large").when(F.col("real").isNull(), "missing file").when(F.col("real") != F.col("sha256"), "digest").when(F.length("content") != F.col("byte_size"), "size").when(F.coalesce(secret, F.lit(False)), "secret")
    bad = j.select("item_id", fault.alias("fault")).where("fault is not null").unionByName(package_faults(items).select("item_id", "fault"))
    if row := bad.orderBy("item_id", "fault").first():
        raise ValueError(f"{row['item_id']}: {row['fault']}")
    total = items.agg(F.sum("byte_size")).first()[0] or 0
    if total > max_total_bytes:
        raise ValueError("package too large")
    none = F.lit(None).cast("string")
    asset = ids.asset_id("sha256", F.col("package_id"), F.col("item_id"), none, none)
    assets = j.join(m.select("package_id", "source_policy"), "package_id").select(asset.alias("asset_id"), ids.blob_path("sha256").alias("relative_path"), "sha256", "byte_size", F.lower("mime").alias("media_type"), F.col("modality").alias("role"), text.redact(F.coalesce("title", F.lit(""))).alias("alt"), urls.sanitize("source_url").alias("source_url"), "source_policy", F.col("package_id").alias("source_id"), "item_id")

    def put(batches):
        from pyspark import TaskContext

        fs, at = pafs.FileSystem.from_uri(aside)
        part, n = f".part-{TaskContext.get().taskAttemptId()}", 0
        for b in batches:
            for path, body in zip(b.column(0).to_pylist(), b.column(1)):
                target = f"{at}/{path}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(target + part) as f:
                    f.write(body.as_buffer())
                fs.move(target + part, target)  # a second attempt writes the same bytes
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = path(whole).getFileSystem(conf)
    if fs.exists(path(whole)) and len(fs.listStatus(path(whole))):
        raise ValueError(f"{folder} isn't empty")

    def write(name: str, value: str) -> str:
        out = fs.create(path(f"{aside}/{name}"), True)
        out.write(bytearray(value.encode()))
        out.close()
        return hashlib.sha256(value.encode()).hexdigest()

    try:
        j.dropDuplicates(["sha256"]).select(ids.blob_path("sha256"), "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one row
        # a package's manifest and receipt are small: its items are bounded
        assets_hash = write("assets.json", asset_manifest(assets).first()["manifest"])
        fields = F.struct(*sorted(_NAMES))
        manifest_hash = write("source-package.json", m.select(F.to_json(fields, {"ignoreNullFields": "false"})).first()[0])
        ids_of = m.first()["package_id"]
        receipt = {"contract": "provenance-source-import.v1", "package_id": ids_of, "manifest_sha256": manifest_hash, "assets_sha256": assets_hash, "asset_count": assets.count(), "total_bytes": total}
        write("import-receipt.json", json.dumps(receipt, sort_keys=True))
        if fs.exists(path(whole)):
            fs.delete(path(whole), False)
        if not fs.rename(path(aside), path(whole)):
            raise OSError(f"{folder} can't be written")
    except BaseException:
        fs.delete(path(aside), True)
        raise
    return spark.read.schema(_STORED).option("multiLine", True).json(f"{whole}/assets.json").select(F.explode("assets").alias("a")).select("a.*")
