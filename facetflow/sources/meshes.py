"""Mesh and label files as tables, and tables as mesh files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetflow.sources.mesh_formats import DECODERS, decoded
from facetflow.sources.mesh_source import ELEMENTS, batches_of

EXTENSIONS = ("glb", "gltf", "obj", "ply", "stl", "3mf", "off")


def listed(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, extension, length) of a folder's mesh files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    extension = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    return found.select("path", extension.alias("extension"), "length").where(F.col("extension").isin(*extensions))


def elements(spark: SparkSession, folder: str, glob: str = "*", kind: str | None = None) -> DataFrame:
    """(mesh, kind v or f, id, x, y, z, v): vertices and faces of the mesh files of a folder, by Spark's own file reader; kind: what all files are, whatever their names.

    A mesh is named by its folder, if that is a partition (mesh=name), else by its file. A file is parsed in one task, as numbering needs all that comes before; files are spread over the cluster.
    A file that is cut short or not understood fails the read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, _, extension = path.rpartition("/")[2].rpartition(".")
                partition = [p for p in path.split("/")[:-1] if p.startswith("mesh=")]
                name, extension = unquote(partition[-1][5:]) if partition else name, (kind or extension).lower()
                if extension in DECODERS:
                    try:
                        yield from batches_of(name, decoded(extension, content.as_py()))
                    except ValueError as wrong:
                        raise ValueError(f"{path}: {wrong}") from wrong

    return files.select("path", "content").mapInArrow(run, ELEMENTS)


def mesh(spark: SparkSession, folder: str, glob: str = "*", kind: str | None = None, normalise: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices (mesh, v, x, y, z), faces (mesh, f, v)); see elements. normalise: cube, extent or half, as geometry.normalised takes it."""
    rows = elements(spark, folder, glob, kind)
    points, faces = rows.where("kind = 'v'").select("mesh", F.col("id").alias("v"), "x", "y", "z"), rows.where("kind = 'f'").select("mesh", F.col("id").alias("f"), "v")
    if normalise:
        from facetflow.operators.geometry import normalised

        points = normalised(points, normalise)
    return points, faces


def point_cloud(spark: SparkSession, folder: str, glob: str = "*.ply") -> DataFrame:
    return mesh(spark, folder, glob)[0]


def _stem(extension: str) -> Column:
    return F.regexp_extract(F.input_file_name(), f"([^/]+)\\.{extension}$", 1)


def line_labels(spark: SparkSession, path: str) -> DataFrame:
    """(mesh, f, label) of .seg files: an integer a line, the line's number is the face."""
    whole = spark.read.text(path, wholetext=True).select(_stem("seg").alias("mesh"), F.split(F.trim("value"), "\\s+").alias("lines"))
    return whole.select("mesh", F.posexplode("lines").alias("f", "label")).where("label <> ''").withColumn("label", F.col("label").cast("int"))


def json_labels(spark: SparkSession, path: str) -> DataFrame:
    """(mesh, f, label) of JSON objects from face to label."""
    whole = spark.read.text(path, wholetext=True).select(_stem("json").alias("mesh"), F.from_json("value", "map<string,int>").alias("m"))
    return whole.select("mesh", F.explode("m").alias("f", "label")).withColumn("f", F.col("f").cast("int"))


def gaps(labels: DataFrame) -> DataFrame:
    """(mesh, faces, last) of meshes whose faces aren't 0 .. n - 1."""
    own = labels.groupBy("mesh").agg(F.count_distinct("f").alias("faces"), F.min("f").alias("first"), F.max("f").alias("last"))
    return own.where((F.col("first") != 0) | (F.col("last") + 1 != F.col("faces"))).select("mesh", "faces", "last")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(item, letters) of crowd answers: the ranks that each answer gives, as letters."""
    schema = "answers array<struct<answerContent: map<string, struct<label: string>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(_stem("json").alias("item"), F.explode("answers").alias("a"))
    return rows.select("item", F.explode(F.map_values("a.answerContent")).alias("c")).select("item", F.col("c.label").alias("letters"))


def labels_json(labels: DataFrame) -> DataFrame:
    """(mesh, value): one JSON object a mesh, faces in order, to be written as text."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("f", "label"))), lambda s: F.struct(s["f"].cast("string").alias("key"), s["label"].alias("value")))
    return labels.groupBy("mesh").agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh, part, id, line): lines of an OBJ file: vertices to six places, faces from 1 (by, f, v, label), the material named where it changes."""
    v = vertices.select("mesh", F.lit(0).alias("part"), F.col("v").alias("id"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("line"))
    order = Window.partitionBy("mesh").orderBy("label", "f")
    text = F.concat(F.lit("f "), F.array_join(F.transform("v", lambda i: (i + 1).cast("string")), " "))
    own = faces.select("mesh", "f", "label", text.alias("text"), F.row_number().over(order).alias("id"), F.lag("label").over(order).alias("before"))
    changed = F.col("before").isNull() | (F.col("before") != F.col("label"))
    f = own.select("mesh", F.lit(1).alias("part"), "id", F.when(changed, F.concat(F.format_string("usemtl label_%d\n", "label"), "text")).otherwise(F.col("text")).alias("line"))
    return v.unionByName(f)


def material_lines(labels: DataFrame, colour: Column) -> DataFrame:
    """(mesh, label, line): a material a label, of a colour (array of 0 to 255)."""
    return labels.select("mesh", "label").distinct().withColumn("_c", colour).select("mesh", "label", F.format_string("newmtl label_%d\nKd %.6f %.6f %.6f", "label", *[F.get("_c", F.lit(i)) / 255 for i in range(3)]).alias("line"))


def write_obj(lines: DataFrame, folder: str) -> None:
    """One folder a mesh with one text file, its lines in order. Tasks are as many as shuffles have, however small the files, as each file takes its time."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(parts, "mesh").sortWithinPartitions("mesh", "part", "id").select("mesh", F.col("line").alias("value")).write.partitionBy("mesh").mode("overwrite").text(folder)


def part_lines(vertices: DataFrame, faces: DataFrame, prefix: str = "part") -> DataFrame:
    """(mesh, part, id, line): an OBJ file for each label above 0 of a mesh (faces with label), named mesh_prefix_001 and so on; its vertices are numbered anew."""
    name = F.concat(F.col("mesh").cast("string"), F.format_string(f"_{prefix}_%03d", "label"))
    own = faces.where("label > 0").select(name.alias("mesh"), "mesh", "label", "f", "v").toDF("name", "mesh", "label", "f", "v")
    used = own.select("name", "mesh", F.explode("v").alias("v")).distinct().withColumn("to", F.row_number().over(Window.partitionBy("name").orderBy("v")) - 1)
    points = used.join(vertices, ["mesh", "v"]).select(F.col("name").alias("mesh"), F.col("to").alias("v"), "x", "y", "z")
    corners = own.select("name", "label", "f", F.posexplode("v").alias("i", "v")).join(used.select("name", "v", "to"), ["name", "v"])
    corners = corners.groupBy(F.col("name").alias("mesh"), "label", "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "to"))), lambda s: s["to"]).alias("v"))
    return obj_lines(points, corners)


def write_parts(faces: DataFrame, folder: str) -> None:
    """A folder a label, without label 0."""
    faces.where("label <> 0").repartition("mesh", "label").write.partitionBy("mesh", "label").mode("overwrite").parquet(folder)


def ply_lines(vertices: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """(mesh, part, id, line): an ascii PLY file of vertices (mesh, v, x, y, z, r, g, b) and perhaps faces (mesh, f, v)."""
    n = vertices.groupBy("mesh").agg(F.count("*").alias("n"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n").cast("string"), F.lit("".join(f"\nproperty {t} {c}" for t, c in [("float", "x"), ("float", "y"), ("float", "z"), ("uchar", "red"), ("uchar", "green"), ("uchar", "blue")])))
    if faces is not None:
        n = n.join(faces.groupBy("mesh").agg(F.count("*").alias("m")), "mesh")
        head = F.concat(head, F.lit("\nelement face "), F.col("m").cast("string"), F.lit("\nproperty list uchar int vertex_indices"))
    out = n.select("mesh", F.lit(0).alias("part"), F.lit(0).alias("id"), F.concat(head, F.lit("\nend_header")).alias("line"))
    out = out.unionByName(vertices.select("mesh", F.lit(1).alias("part"), F.col("v").alias("id"), F.format_string("%.6f %.6f %.6f %d %d %d", "x", "y", "z", "r", "g", "b").alias("line")))
    if faces is not None:
        out = out.unionByName(faces.select("mesh", F.lit(2).alias("part"), F.col("f").alias("id"), F.concat(F.size("v").cast("string"), F.lit(" "), F.array_join(F.col("v").cast("array<string>"), " ")).alias("line")))
    return out


def not_yet_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without an output."""
    return items.join(done.select(key), key, "left_anti")


def in_natural_order(path: Column) -> Column:
    """The last number in a file's name, to order by."""
    return F.regexp_extract(path, "(\\d+)[^\\d/]*$", 1).cast("int")


def scene(geometries: DataFrame, poses: DataFrame) -> DataFrame:
    """Vertices (scene, name, v, x, y, z) of a scene's geometries, each moved by its pose (scene, name, m)."""
    from facetflow.operators.geometry import transformed

    return transformed(geometries.join(poses, ["scene", "name"]), F.col("m")).drop("m")
