"""Sources by name, blobs and manifests, TeX packages, tags, container images, and text that is handed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.storage import stored

from . import files, tables

CHUNKS = ("doc_id", "path", "text", "base_line", "base_offset")


def _table(name: str, ident: str, text: str) -> Callable[..., DataFrame]:
    def reader(spark: SparkSession, folder: str) -> DataFrame:
        zero = F.lit(0).cast("long")
        return tables.read(spark, folder, name).select(F.col(ident).alias("doc_id"), F.concat(F.lit(f"{name}/"), F.col(ident).cast("string")).alias("path"), F.col(text).alias("text"), zero.alias("base_line"), zero.alias("base_offset"))

    return reader


def _folder(spark: SparkSession, root: str, **options) -> DataFrame:
    found, _ = files.read_files(spark, root, **options)
    zero = F.lit(0).cast("long")
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "text", zero.alias("base_line"), zero.alias("base_offset"))


#: Readers by name: each takes the session, a place and its own options, and gives chunks.
READERS: dict[str, Callable[..., DataFrame]] = {"documents": _table("documents", "doc_id", "text"), "pages": _table("pages", "page_id", "html"), "conversations": _table("conversations", "conv_id", "text"), "events": _table("events", "event_id", "props"), "filesystem": _folder}
#: Names that were readers once, and what took their place.
RETIRED = {"fs": "filesystem", "web": "pages", "chat": "conversations"}


def source(name: str) -> Callable[..., DataFrame]:
    """The reader of that name. A retired name and an unknown one are different errors."""
    if name in RETIRED:
        raise ValueError(f"source {name} is retired; use {RETIRED[name]}")
    if name not in READERS:
        raise ValueError(f"no source {name}; there are {', '.join(sorted(READERS))}")
    return READERS[name]


def from_text(spark: SparkSession, text: str, path: str = "stdin", most: int = 10 << 20) -> tuple[DataFrame, DataFrame]:
    """A text that is handed in, as one chunk; over ``most`` bytes it is refused, and a coverage row (path, reason) tells so."""
    fits = len(text.encode()) <= most
    chunk = [(0, path, text, 0, 0)] if fits else []
    return spark.createDataFrame(chunk, "doc_id long, path string, text string, base_line long, base_offset long"), spark.createDataFrame([] if fits else [(path, "too_large")], "path string, reason string")


def git_blobs(chunks: DataFrame) -> DataFrame:
    """doc_id, path and the id that Git gives a file of this text."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string")), "UTF-8")
    return chunks.select("doc_id", "path", F.sha1(F.concat(head, F.unhex(F.lit("00")), body)).alias("blob_id"))


def staged(blobs: DataFrame, before: DataFrame) -> DataFrame:
    """Blobs (path, blob_id) that are new or changed against a manifest of the same columns, with what they are."""
    old = before.select("path", F.col("blob_id").alias("_old"))
    return blobs.join(old, "path", "left").where("_old IS NULL OR _old <> blob_id").withColumn("change", F.when(F.col("_old").isNull(), "added").otherwise("modified")).drop("_old")


def fingerprint(blobs: DataFrame, *keys: str) -> DataFrame:
    """One number for each group of blobs, whatever their order: the sum of the hashes of (path, blob_id), modulo 2^61 - 1."""
    part = F.pmod(F.xxhash64("path", "blob_id"), F.lit((1 << 61) - 1))
    return blobs.groupBy(*keys).agg(F.pmod(F.sum(part.cast("decimal(38,0)")), F.lit((1 << 61) - 1).cast("decimal(38,0)")).cast("long").alias("fingerprint"), F.count("*").alias("n_blobs"))


#: Rows of a set of nodes up to which it is broadcast.
FEW = 100_000


def _sized(rows: DataFrame) -> DataFrame:
    """A stored table as it is to be joined, by its rows: the size of its files says little, as numbers in order take next to none, and what is small on disk may not fit in the driver."""
    return F.broadcast(rows) if rows.count() <= FEW else rows.hint("merge")


def reached(starts: DataFrame, edges: DataFrame, *scope: str) -> DataFrame:
    """Nodes (scope, node) that edges (scope, a, b) reach from ``starts`` (scope, node), themselves included; cycles do no harm.

    By pointer doubling: each node's first edge makes a chain, and tables of jumps of 1, 2, 4, ... steps along the chains are joined with themselves. A set is closed under
    its chains in as many joins as there are tables. What the other edges lead to is the next set. So the number of jobs is the logarithm of the
    longest chain, times how often a way has to leave a chain by another edge: a history without branches takes one round, whatever its length.
    Tables of edges and jumps are never broadcast, sets of nodes only if they are small.
    """
    keys = [*scope, "node"]
    edges = stored(edges.select(*scope, "a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    jumps = [stored(edges.groupBy(*scope, "a").agg(F.min("b").alias("b")), "jump")]
    nodes = jumps[0].count()
    while nodes >> len(jumps):  # no chain has more steps than nodes
        last = jumps[-1]
        further = stored(last.withColumnRenamed("b", "_at").join(last.select(*scope, F.col("a").alias("_at"), "b").hint("merge"), [*scope, "_at"]).select(*scope, "a", "b"), "jump")
        if further.isEmpty():
            break
        jumps.append(further)
    others = stored(edges.join(jumps[0].hint("merge"), [*scope, "a", "b"], "left_anti"), "others")
    seen, front = None, stored(starts.select(*keys).distinct(), "front")
    while not front.isEmpty():
        for jump in jumps:
            beyond = _sized(front).join(jump.withColumnRenamed("a", "node"), keys).select(*scope, F.col("b").alias("node"))
            front = stored(front.unionByName(beyond).distinct(), "front")
        if seen is not None:
            front = stored(front.join(_sized(seen), keys, "left_anti"), "front")
        seen = front if seen is None else stored(seen.unionByName(front), "reached")
        front = _sized(front).join(others.withColumnRenamed("a", "node"), keys).select(*scope, F.col("b").alias("node")).distinct()
        front = stored(front.join(_sized(seen), keys, "left_anti"), "front")
    return _sized(seen if seen is not None else front)


def tex_roles(members: DataFrame) -> DataFrame:
    """Members of TeX packages (package, name, text) with their role: root (begins a document), referenced (from a root, over any way), or orphaned.

    References in comments don't count; a name may be written without its ending.
    """
    bare = members.select("package", "name", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)(^|[^\\])%.*$", "$1").alias("text"))
    root = F.col("text").rlike(r"\\document(?:class|style)\b")
    named = F.explode(F.regexp_extract_all("text", F.lit(r"\\(?:input|include|subfile|bibliography)\{([^}]+)\}"), F.lit(1)))
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\./", ""), r"\.(tex|bib)$", "")
    edges = bare.select("package", stem(F.col("name")).alias("a"), named.alias("to")).select("package", "a", stem(F.trim("to")).alias("b")).distinct()
    roots = bare.where(root).select("package", stem(F.col("name")).alias("node"))
    seen = reached(roots, edges, "package").withColumn("_seen", F.lit(True))
    rows = bare.select("package", "name", stem(F.col("name")).alias("node"), root.alias("_root")).join(seen, ["package", "node"], "left")
    return rows.select("package", "name", F.when(F.col("_root"), "root").when(F.col("_seen"), "referenced").otherwise("orphaned").alias("role"))


def tag_messages(tags: DataFrame, commits: DataFrame, heads: DataFrame) -> DataFrame:
    """Annotated tags (tag, target, message) with whether a head's history holds their commit. ``commits``: commit, parent; ``heads``: commit."""
    edges = commits.where("parent IS NOT NULL").select(F.col("commit").alias("a"), F.col("parent").alias("b"))
    seen = reached(heads.select(F.col("commit").alias("node")), edges).withColumn("_seen", F.lit(True))
    return tags.join(seen, tags.target == seen.node, "left").select("tag", "target", "message", F.coalesce("_seen", F.lit(False)).alias("reachable"))


def hosted(files: DataFrame, host: str, owner: str) -> DataFrame:
    """Files of cloned repositories (repository, path, ...) with the address of the repository they came from in place of the clone's folder."""
    return files.withColumn("path", F.concat(F.lit(f"{host}/{owner}/"), "repository", F.lit("/"), F.regexp_replace("path", r"^.*?/clone/[^/]*/", "")))


LAYERS = "doc_id long, layer string, path string, content binary, state string"


def image_members(images: DataFrame, most: int = 1 << 28) -> DataFrame:
    """Files in the layers of container images (doc_id, content: a tar as ``docker save`` or an OCI layout writes it): layer, path, content and state.

    Layers come in the manifest's order; ``state``: read, whiteout (the path is removed), truncated (of an image, what goes beyond ``most`` bytes), bad_digest (an OCI
    blob that isn't what its name says) or invalid (no image). The configuration is a member of the layer ``config``.
    """

    def members(doc_id: int, content: bytes) -> Iterator[tuple]:
        import hashlib
        import io
        import json
        import tarfile

        try:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as outer:
                blobs = {i.name.removeprefix("./"): i for i in outer.getmembers() if i.isfile()}
                read = lambda name: outer.extractfile(blobs[name]).read()
                if "manifest.json" in blobs:
                    wanted = [(m["Config"], m["Layers"]) for m in json.loads(read("manifest.json"))]
                else:
                    at = lambda d: "blobs/" + d["digest"].replace(":", "/", 1)
                    wanted = [(at(m["config"]), [at(x) for x in m["layers"]]) for m in (json.loads(read(at(d))) for d in json.loads(read("index.json"))["manifests"])]
                left = most
                for config, layers in wanted:
                    yield doc_id, "config", config, read(config), "read"
                    for layer in layers:
                        data = read(layer)
                        if layer.startswith("blobs/sha256/") and hashlib.sha256(data).hexdigest() != layer.rsplit("/", 1)[-1]:
                            yield doc_id, layer, None, None, "bad_digest"
                            continue
                        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as inner:
                            for info in inner:
                                folder, _, name = info.name.rpartition("/")
                                if name.startswith(".wh."):
                                    yield doc_id, layer, "/".join(x for x in (folder, name[4:]) if x), None, "whiteout"
                                elif info.isfile():
                                    held = inner.extractfile(info).read(left + 1)
                                    yield doc_id, layer, info.name, held[:left], "read" if len(held) <= left else "truncated"
                                    left -= min(len(held), left)
        except (tarfile.TarError, KeyError, ValueError, TypeError, AttributeError, OSError, EOFError):
            yield doc_id, None, None, None, "invalid"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in LAYERS.split(", ")]
        for frame in frames:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                rows = list(members(doc_id, bytes(content or b"")))
                yield pd.DataFrame(rows, columns=names)

    return images.select("doc_id", "content").mapInPandas(run, LAYERS)
