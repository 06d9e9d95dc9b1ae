"""Knowledge-catalogue operations on whole tables (B01-B18): listings, trees, moves, cascades, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col
MAX_DEPTH, MAX_BYTES, UPLOAD_HOURS = 20, 50 * 1024 * 1024, 24
EXTENSIONS = ["pdf", "docx", "txt", "md", "html"]


def visible(rows: DataFrame) -> DataFrame:
    """B13."""
    return rows.where("deleted_at is null")


def soft_delete(rows: DataFrame, ids: DataFrame, key: str, at: Column) -> DataFrame:
    """B13."""
    marked = rows.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn("deleted_at", F.when(c("_gone") & c("deleted_at").isNull(), at).otherwise(c("deleted_at"))).drop("_gone")


def listing(rows: DataFrame, *order: Column, page: int = 1, size: int = 20, status: str | None = None, name: str | None = None, column: str = "name") -> DataFrame:
    """A page of rows by status and part of a name."""
    rows = rows.where(c("status") == status) if status else rows
    rows = rows.where(c(column).ilike(f"%{name}%")) if name else rows
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_info(rows: DataFrame, page: int, size: int) -> DataFrame:
    """B04."""
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(c("total") / size).alias("total_pages"), (F.lit(page * size) < c("total")).alias("has_next"))


def folder_contents(folders: DataFrame, documents: DataFrame, folder: str | None) -> DataFrame:
    """Kind, id, name of what a folder (null: the root) holds."""
    at = lambda column: c(column).isNull() if folder is None else c(column) == folder
    return visible(folders).where(at("parent_folder_id")).select(F.lit("folder").alias("kind"), c("folder_id").alias("id"), "name").unionByName(visible(documents).where(at("folder_id")).select(F.lit("document").alias("kind"), c("document_id").alias("id"), c("title").alias("name")))


def tree(folders: DataFrame, documents: DataFrame, depth: int) -> DataFrame:
    """Folders down to a depth with their number of documents."""
    n = visible(documents).groupBy("folder_id").agg(F.count("*").alias("documents"))
    return visible(folders).where(c("depth") <= depth).join(n, "folder_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def under(path: Column, root: Column) -> Column:
    """The folder of a path and all below it; other folders whose names begin alike are not."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def subtree(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """folder_id, root_id. Every path meets its ancestors by equality, so no pairs are tried."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return folders.select("folder_id", F.explode(up).alias("_at")).join(roots.select(c("folder_id").alias("root_id"), c("path").alias("_at")), "_at").select("folder_id", "root_id")


def move_folders(folders: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders with paths and depths rewritten, violations). Moves: folder_id, target_id (null: the root).

    Folder and target must be there and active; a folder moves neither into itself nor below itself, no deeper than
    MAX_DEPTH, and not beside a folder of its name. The first fault in that order is told."""
    live = (visible(folders) if "deleted_at" in folders.columns else folders).withColumn("_live", c("status") == "active" if "status" in folders.columns else F.lit(True))
    f = live.select("folder_id", "path", "depth", "name", "_live")
    targets = live.select(c("folder_id").alias("target_id"), c("path").alias("target_path"), c("depth").alias("target_depth"), c("_live").alias("_target"))
    rows = moves.select("folder_id", "target_id").join(f, "folder_id", "left").join(targets, "target_id", "left")
    deepest = subtree(folders, f.join(moves.select("folder_id"), "folder_id", "left_semi")).join(folders.select("folder_id", "depth"), "folder_id").groupBy(c("root_id").alias("folder_id")).agg(F.max("depth").alias("deepest"))
    names = visible(folders).select(F.coalesce("parent_folder_id", F.lit("")).alias("_at"), "name", c("folder_id").alias("sibling"))
    near = rows.where("name is not null").withColumn("_at", F.coalesce("target_id", F.lit(""))).join(names, ["_at", "name"])
    clash = near.where(c("folder_id") != c("sibling")).select("folder_id").distinct().withColumn("_clash", F.lit(True))
    rows = rows.join(deepest, "folder_id", "left").join(clash, "folder_id", "left")
    shift = F.coalesce("target_depth", F.lit(-1)) + 1 - c("depth")
    code = (F.when(~F.coalesce("_live", F.lit(False)), "folder_not_found").when(c("target_id") == c("folder_id"), "into_itself")
            .when(c("target_id").isNotNull() & ~F.coalesce("_target", F.lit(False)), "target_not_found").when(F.coalesce(under(c("target_path"), c("path")), F.lit(False)), "cycle")
            .when(c("deepest") + shift >= MAX_DEPTH, "too_deep").when(c("_clash"), "name_conflict"))
    checked = rows.withColumns({"error_code": code, "shift": shift, "new_path": F.concat(F.coalesce("target_path", F.lit("")), F.lit("/"), "name")})
    good = checked.where("error_code is null").select("folder_id", c("path").alias("_old"), "new_path", "shift", "target_id")
    inner = subtree(folders, good.select("folder_id", c("_old").alias("path"))).join(good.withColumnRenamed("folder_id", "root_id"), "root_id")
    moved = folders.join(inner, "folder_id", "left")
    is_root = c("root_id") == c("folder_id")
    rest = F.substr("path", F.length("_old") + 1, F.length("path"))
    out = moved.withColumns({
        "path": F.when(c("root_id").isNotNull(), F.concat("new_path", rest)).otherwise(c("path")), "depth": c("depth") + F.coalesce("shift", F.lit(0)),
        "parent_folder_id": F.when(is_root, c("target_id")).otherwise(c("parent_folder_id"))})
    return out.select(folders.columns), checked.where("error_code is not null").select("folder_id", "error_code")


def name_conflicts(rows: DataFrame, *scope: str, name: str = "name") -> DataFrame:
    """Names that stand twice in their scope, deleted rows aside."""
    return visible(rows).groupBy(*scope, name).agg(F.count("*").alias("n")).where("n > 1")


def set_status(rows: DataFrame, ids: DataFrame, key: str, status: str, frm: str | None = None) -> DataFrame:
    """Rows of the ids get a status."""
    marked = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = c("_hit") & (c("status") == frm) if frm else c("_hit")
    return marked.withColumn("status", F.when(hit, status).otherwise(c("status"))).drop("_hit").select(rows.columns)


def archive(bases: DataFrame, folders: DataFrame, documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Knowledge bases with their folders and documents."""
    key = "knowledge_base_id"
    return tuple(set_status(x, ids, key, "archived", "active") for x in (bases, folders, documents))


def restore(bases: DataFrame, ids: DataFrame) -> DataFrame:
    return set_status(bases, ids, "knowledge_base_id", "active", "archived")


def delete_targets(documents: DataFrame, folders: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, document_id of the documents below each target. Targets: target_id, kind (knowledge_base, folder, document), id."""
    of = lambda kind: targets.where(c("kind") == kind).select("target_id", "id")
    bases = of("knowledge_base").join(documents.select("document_id", c("knowledge_base_id").alias("id")), "id")
    roots = of("folder").join(folders.select(c("folder_id").alias("id"), "path"), "id")
    inner = subtree(folders, roots.select(c("id").alias("folder_id"), "path")).join(of("folder").select("target_id", c("id").alias("root_id")), "root_id")
    below = inner.join(documents.select("document_id", "folder_id"), "folder_id")
    own = of("document").select("target_id", c("id").alias("document_id")).join(documents.select("document_id"), "document_id", "left_semi")
    return bases.select("target_id", "document_id").unionByName(below.select("target_id", "document_id")).unionByName(own).distinct()


def deletable(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document ids of the targets, targets that a legal hold blocks). Targets: target_id, document_id."""
    held = targets.join(documents.where("legal_hold").select("document_id"), "document_id", "left_semi").select("target_id").distinct()
    return targets.join(held, "target_id", "left_anti").select("document_id").distinct(), held


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents and all that hangs on them: versions, chunks, embeddings, uploads; with unblocked targets (kind, id)
    also folders with what lies below them, and a knowledge base's folders, conversations and their messages."""
    versions = tables["versions"].join(ids, "document_id", "left_semi").select("document_version_id", "upload_session_id")
    chunks = tables["chunks"].join(versions, "document_version_id", "left_semi").select("chunk_id")
    gone = {"documents": (ids, "document_id"), "versions": (ids, "document_id"), "chunks": (versions, "document_version_id"), "embeddings": (chunks, "chunk_id"), "uploads": (versions, "upload_session_id")}
    if targets is not None:
        bases = targets.where("kind = 'knowledge_base'").select(c("id").alias("knowledge_base_id"))
        gone["knowledge_bases"] = (bases, "knowledge_base_id")
        if "folders" in tables:
            f = tables["folders"]
            roots = f.join(targets.where("kind = 'folder'").select(c("id").alias("folder_id")), "folder_id", "left_semi").select("folder_id", "path")
            dead = subtree(f, roots).select("folder_id")
            gone["folders"] = (dead.unionByName(f.join(bases, "knowledge_base_id", "left_semi").select("folder_id")) if "knowledge_base_id" in f.columns else dead, "folder_id")
        if "conversations" in tables:
            talks = tables["conversations"].join(bases, "knowledge_base_id", "left_semi").select("conversation_id")
            gone |= {"conversations": (talks, "conversation_id"), "messages": (talks, "conversation_id")}
    return {name: rows.join(gone[name][0].select(gone[name][1]), gone[name][1], "left_anti") if name in gone else rows for name, rows in tables.items()}


def orphaned_keys(versions: DataFrame, uploads: DataFrame, ids: DataFrame) -> DataFrame:
    """Storage keys that a delete leaves behind."""
    v = versions.join(ids, "document_id", "left_semi")
    mine = v.select(F.explode(F.array("original_key", "extracted_key")).alias("storage_key"))
    staged = uploads.join(v.select("upload_session_id"), "upload_session_id", "left_semi").select(c("staging_key").alias("storage_key"))
    return mine.unionByName(staged).where("storage_key is not null").distinct()


def recount(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """B12."""
    n = visible(documents).groupBy("knowledge_base_id").agg(F.count("*").alias("_n"))
    return bases.join(n, "knowledge_base_id", "left").withColumn("document_count", F.coalesce("_n", F.lit(0))).drop("_n")


def admit(uploads: DataFrame, now: Column) -> DataFrame:
    """error_code and status of uploads. Uploads: file_name, declared_size, content (null: none came), checksum (null: none given), created_at.

    A file is admitted by its declared size, over 0 and at most MAX_BYTES, and its suffix; it is completed in time, with as
    many bytes as declared, and with the checksum, where one is given."""
    suffix = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    size = c("declared_size")
    code = (F.when(F.coalesce(size <= 0, F.lit(True)), "empty_file").when(size > MAX_BYTES, "file_too_large").when(~F.coalesce(suffix.isin(EXTENSIONS), F.lit(False)), "unsupported_format")
            .when(now > c("created_at") + F.expr(f"interval {UPLOAD_HOURS} hours"), "upload_expired").when(c("content").isNull(), "content_required")
            .when(F.length("content") != size, "size_mismatch").when((c("checksum") != "") & (F.sha2("content", 256) != c("checksum")), "checksum_mismatch"))
    status = F.when(code.isNull(), "completed").when(code == "upload_expired", "expired").otherwise("rejected")
    return uploads.withColumns({"error_code": code, "status": status})


def bind_versions(versions: DataFrame, documents: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, documents, rejected uploads with error_code). Uploads: upload_session_id, document_id, document_version_id, status, staging_key, checksum.

    The document must be there, neither archived nor deleted; the upload completed, in no version yet, with its content.
    Of several requests for one upload the first document_version_id has it."""
    used = versions.select("upload_session_id").where("upload_session_id is not null").distinct().withColumn("_used", F.lit(True))
    of = documents.select("document_id", c("status").alias("_status"))
    rows = uploads.join(of, "document_id", "left").join(used, "upload_session_id", "left")
    turn = F.row_number().over(W.partitionBy("upload_session_id").orderBy("document_version_id"))
    code = (F.when(c("_status").isNull(), "document_not_found").when(c("_status").isin("archived", "deleted"), "document_not_mutable")
            .when(F.coalesce(c("status") != "completed", F.lit(True)), "upload_not_completed").when(c("_used"), "upload_already_used")
            .when(c("staging_key").isNull() | c("checksum").isNull(), "upload_without_content"))
    checked = rows.withColumn("error_code", code)
    fresh = checked.where("error_code is null").withColumn("_turn", turn)
    twice = fresh.where("_turn > 1").withColumn("error_code", F.lit("upload_already_used")).drop("_turn")
    rejected = checked.where("error_code is not null").unionByName(twice).select(*uploads.columns, "error_code")
    last = versions.groupBy("document_id").agg(F.max("version_number").alias("_last"))
    order = W.partitionBy("document_id").orderBy("upload_session_id")
    number = (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int")
    new = fresh.where("_turn = 1").join(last, "document_id", "left").withColumn("version_number", number)
    new = new.select("document_id", "document_version_id", "upload_session_id", "version_number", c("checksum").alias("content_hash"), F.lit("uploaded").alias("processing_status"))
    current = new.groupBy("document_id").agg(F.max_by("document_version_id", "version_number").alias("_new"))
    docs = documents.join(current, "document_id", "left").withColumns({"current_version_id": F.coalesce("_new", "current_version_id"), "status": F.when(c("_new").isNotNull() & (c("status") == "draft"), "active").otherwise(c("status"))})
    return versions.unionByName(new, allowMissingColumns=True), docs.select(documents.columns), rejected


MAX_NAME, MAX_TITLE, MAX_TAGS, MAX_METADATA = 200, 500, 50, 16 * 1024
LANGUAGE = r"^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$"


def _between(text: Column, most: int) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).between(1, most), F.lit(False))


def written_length(json: Column) -> Column:
    """Characters of compact JSON whose letters beyond ASCII are escapes."""
    astral = F.regexp_count(json, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(json) + 5 * F.regexp_count(json, F.lit(r"[^\x{00}-\x{7F}]")) + 6 * astral


def metadata_errors(rows: DataFrame) -> DataFrame:
    """document_id, errors of its language code, title, tags and metadata."""
    language = c("declared_language").isNull() | c("declared_language").rlike(LANGUAGE)
    tags = (F.size("tags") <= MAX_TAGS) & F.forall("tags", lambda t: F.coalesce(~t.rlike(r"(?U)^\s*$"), F.lit(False)))
    errors = F.array_compact(F.array(
        F.when(~language, "invalid_language"), F.when(~_between(c("title"), MAX_TITLE), "invalid_title"), F.when(~F.coalesce(tags, F.lit(True)), "invalid_tags"),
        F.when(written_length(F.to_json("metadata")) > MAX_METADATA, "metadata_too_large")))
    return rows.select("document_id", errors.alias("errors")).where(F.size("errors") > 0)


def name_errors(rows: DataFrame, key: str) -> DataFrame:
    """B16 for knowledge bases and folders: key, error_code of names that are blank or too long."""
    return rows.where(~_between(c("name"), MAX_NAME)).select(key, F.lit("invalid_name").alias("error_code"))


def placement_errors(moves: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents moved or restored to a folder that is absent or not active. Moves: document_id, folder_id."""
    rows = moves.where("folder_id is not null").join(folders.select("folder_id", "status"), "folder_id", "left")
    return rows.select("document_id", F.when(c("status").isNull(), "folder_not_found").when(c("status") != "active", "folder_not_active").alias("error_code")).where("error_code is not null")


def inventory(**tables: DataFrame) -> DataFrame:
    """Entity, n."""
    out = None
    for name, rows in tables.items():
        part = rows.agg(F.lit(name).alias("entity"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
