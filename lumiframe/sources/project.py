"""Projects: metadata as XML, points and correspondences as tables, text forms of matches and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETUP_XML = "id INT, size STRING, voxel STRING, unit STRING, channel INT, angle INT, illumination INT, tile INT"


def write_setups(setups: DataFrame, path: str) -> None:
    """View setups as XML, an element each."""
    rows = setups.select(F.col("setup").alias("id"), F.concat_ws(" ", "sx", "sy", "sz").alias("size"), F.concat_ws(" ", "vx", "vy", "vz").alias("voxel"), "unit", "channel", "angle", "illumination", "tile")
    rows.write.mode("overwrite").format("xml").option("rootTag", "ViewSetups").option("rowTag", "ViewSetup").save(path)


def read_setups(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.format("xml").option("rowTag", "ViewSetup").schema(SETUP_XML).load(path)
    part = lambda c, i, t: F.split(c, " ")[i].cast(t)
    return x.select(F.col("id").alias("setup"), "channel", "angle", "illumination", "tile", *[part("size", i, "long").alias(f"s{c}") for i, c in enumerate("xyz")], *[part("voxel", i, "double").alias(f"v{c}") for i, c in enumerate("xyz")], "unit")


def backups(path: str, spark: SparkSession, most: int = 5) -> None:
    """Keep the last versions of a folder as path~1 (the newest) to path~5 before it is written anew."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    store = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at(path)):
        return
    store.delete(at(f"{path}~{most}"), True)
    for i in range(most - 1, 0, -1):
        if store.exists(at(f"{path}~{i}")):
            store.rename(at(f"{path}~{i}"), at(f"{path}~{i + 1}"))
    store.rename(at(path), at(f"{path}~1"))


def write_points(points: DataFrame, path: str) -> None:
    """Points by label and timepoint, sorted by setup and id: filters on any of these prune files or row groups.

    Rows are dealt by ranges of all four, so a label's points at one timepoint are as many files as they need.
    """
    points.repartitionByRange("tp", "label", "setup", "id").sortWithinPartitions("tp", "label", "setup", "id").write.mode("overwrite").partitionBy("tp", "label").parquet(path)


def read_points(spark: SparkSession, path: str, tp: int | None = None, setup: int | None = None, label: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    for c, v in (("tp", tp), ("setup", setup), ("label", label)):
        if v is not None:
            out = out.where(F.col(c) == v)
    return out


def encode_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Correspondences with a code for the other side's list, and the dictionary of codes: `tp,setup,label`."""
    from pyspark.sql import Window

    name = F.concat_ws(",", "c_tp", "c_setup", "c_label")
    codes = links.select(name.alias("name")).distinct().withColumn("code", F.row_number().over(Window.orderBy("name")) - 1)
    return links.withColumn("name", name).join(codes, "name").select("tp", "setup", "label", "id", "c_id", "code"), codes


def decode_links(coded: DataFrame, codes: DataFrame) -> DataFrame:
    part = F.split("name", ",", 3)
    return coded.join(codes, "code").select("tp", "setup", "label", "id", part[0].cast("int").alias("c_tp"), part[1].cast("int").alias("c_setup"), part[2].alias("c_label"), "c_id")


def parse_matches(line: Column) -> Column:
    """Pairs (p, q) of a line of a match file: blank-separated, after three tokens."""
    t = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    n = F.greatest(F.lit(0), F.floor((F.size(t) - 3) / 2).cast("int"))
    return F.when(n == 0, F.array().cast("array<struct<p:double,q:double>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(t, 3 + 2 * i).cast("double").alias("p"), F.get(t, 4 + 2 * i).cast("double").alias("q"))))


def format_matches(head: Column, pairs: Column) -> Column:
    return F.concat_ws(" ", head, F.array_join(F.transform(pairs, lambda x: F.concat_ws(" ", x["p"].cast("string"), x["q"].cast("string"))), " "))


def dataset_path(group: str, setup: Column, tp: Column) -> Column:
    return F.format_string(f"{group}/setup%d/timepoint%d/dataset", setup, tp)


def reduce_dataset(tables: dict[str, DataFrame], views: DataFrame) -> dict[str, DataFrame]:
    """All tables of a dataset for some of its views: rows keyed by view, or by setup, of those views only."""
    v, s = views.select("tp", "setup").distinct(), views.select("setup").distinct()
    return {n: t.join(v, ["tp", "setup"], "left_semi") if "tp" in t.columns and "setup" in t.columns else t.join(s, "setup", "left_semi") if "setup" in t.columns else t for n, t in tables.items()}


def add_fused_setups(setups: DataFrame, groups: DataFrame) -> DataFrame:
    """Setups with one more for each fused group (title, sx, sy, sz), numbered after the last."""
    from pyspark.sql import Window

    last = setups.agg(F.max("setup").alias("last"))
    new = groups.crossJoin(F.broadcast(last)).withColumn("setup", (F.col("last") + F.row_number().over(Window.orderBy("title"))).cast("int"))  # one row
    cols = [c for c in setups.columns if c in new.columns]
    return setups.unionByName(new.select(*cols), allowMissingColumns=True)


def delete_points(spark: SparkSession, path: str, tp: int | None = None, setup: int | None = None, label: str | None = None) -> None:
    """Take points of write_points() away: all that agree with what is given. Lists of other views in the same files are written anew.

    Only the folders of the timepoints and labels in question are touched; each is replaced once its new content stands
    beside it.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    store = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    glob = f"{path}/tp={'*' if tp is None else tp}/label={'*' if label is None else label}"
    for f in store.globStatus(at(glob)) or []:
        folder = f.getPath().toString()
        if setup is not None:
            left = spark.read.parquet(folder).where(F.col("setup") != setup)
            aside = f"{path}/_new-{f.getPath().getParent().getName()}-{f.getPath().getName()}"
            left.write.mode("overwrite").parquet(aside)
            store.delete(at(folder), True)
            store.rename(at(aside), at(folder))
        else:
            store.delete(at(folder), True)


def _field_folder(root: str, setup: int, tp: int) -> str:
    return f"{root}/setup{setup}/timepoint{tp}/dataset"


def write_fields(field: DataFrame, path: str, cells: tuple[int, int, int]) -> int:
    """Coefficient fields (tp, setup, cell, a, b) as chunked arrays of a folder per view, slopes and offsets; returns how many views.

    A task writes a view's arrays whole, so a retried one repeats its files. A cell without a map is identity.
    """
    import json

    import pandas as pd

    n = cells[0] * cells[1] * cells[2]

    def work(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from lumiframe.sources.images import open_store, put_file

        store, root = open_store(path)
        folder = _field_folder(root, int(g["setup"].iloc[0]), int(g["tp"].iloc[0]))
        for name, usual in (("a", 1.0), ("b", 0.0)):
            v = np.full(n, usual, "<f8")
            v[g["cell"].to_numpy(int)] = g[name].to_numpy(float)
            meta = {"zarr_format": 2, "shape": list(cells[::-1]), "chunks": list(cells[::-1]), "dtype": "<f8", "compressor": None, "fill_value": usual, "order": "C", "filters": None, "dimension_separator": "/"}
            put_file(store, f"{folder}/{name}/.zarray", json.dumps(meta).encode())
            put_file(store, f"{folder}/{name}/0/0/0", v.tobytes())
        return pd.DataFrame({"n": [1]})

    rows = field.where("cell is not null").select("tp", "setup", "cell", "a", "b")
    return rows.groupBy("tp", "setup").applyInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def read_fields(views: DataFrame, path: str) -> DataFrame:
    """tp, setup, cell, a, b of the fields of views (tp, setup); a view without a field gives no row."""
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import numpy as np
        from pyarrow import fs

        from lumiframe.sources.images import open_store

        store, root = open_store(path)
        for df in parts:
            for r in df.itertuples():
                folder = _field_folder(root, r.setup, r.tp)
                if store.get_file_info(f"{folder}/a/.zarray").type == fs.FileType.NotFound:
                    continue
                v = {}
                for name in "ab":
                    with store.open_input_file(f"{folder}/{name}/.zarray") as f:
                        kind = json.loads(f.read())["dtype"]
                    with store.open_input_file(f"{folder}/{name}/0/0/0") as f:
                        v[name] = np.frombuffer(f.read(), kind)
                yield pd.DataFrame({"tp": r.tp, "setup": r.setup, "cell": np.arange(len(v["a"])), **v})

    return views.select(F.col("tp").cast("int"), F.col("setup").cast("int")).distinct().mapInPandas(run, "tp int, setup int, cell int, a double, b double")


# ---- projects in one XML file -------------------------------------------------------------------------------------


def write_project(path: str, setups: DataFrame, registrations: DataFrame, missing: DataFrame, boxes: DataFrame, points: DataFrame, psfs: DataFrame, timepoints: str) -> None:
    """A project's metadata as one XML file, whose earlier versions are kept by backups().

    setups as in write_setups(); registrations: tp, setup, ord, name, m, the first being outermost; missing: tp, setup;
    boxes: name, min_x .. max_z; points: tp, setup, label, params, path; psfs: tp, setup, path. Metadata of views only,
    which the driver writes row by row.
    """
    from xml.sax.saxutils import escape, quoteattr

    from lumiframe.sources.images import open_store

    spark = setups.sparkSession
    backups(path, spark)
    store, at = open_store(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    text = lambda x: escape(str(x))

    def lines():
        yield '<?xml version="1.0" encoding="UTF-8"?>\n<SpimData version="0.2">\n<BasePath type="relative">.</BasePath>\n<SequenceDescription>\n<ViewSetups>\n'
        for r in setups.orderBy("setup").toLocalIterator():
            kinds = "".join(f"<{c}>{r[c]}</{c}>" for c in ("illumination", "channel", "tile", "angle"))
            yield f"<ViewSetup><id>{r['setup']}</id><size>{r['sx']} {r['sy']} {r['sz']}</size><voxelSize><unit>{text(r['unit'])}</unit><size>{r['vx']} {r['vy']} {r['vz']}</size></voxelSize><attributes>{kinds}</attributes></ViewSetup>\n"
        yield f'</ViewSetups>\n<Timepoints type="pattern"><integerpattern>{text(timepoints)}</integerpattern></Timepoints>\n<MissingViews>\n'
        for r in missing.orderBy("tp", "setup").toLocalIterator():
            yield f'<MissingView timepoint="{r["tp"]}" setup="{r["setup"]}"></MissingView>\n'
        yield "</MissingViews>\n</SequenceDescription>\n<ViewRegistrations>\n"
        for r in registrations.groupBy("tp", "setup").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "m"))).alias("list")).orderBy("tp", "setup").toLocalIterator():
            maps = "".join(f'<ViewTransform type="affine"><Name>{text(t["name"])}</Name><affine>{" ".join(repr(float(v)) for v in t["m"])}</affine></ViewTransform>' for t in r["list"])
            yield f'<ViewRegistration timepoint="{r["tp"]}" setup="{r["setup"]}">{maps}</ViewRegistration>\n'
        yield "</ViewRegistrations>\n<ViewInterestPoints>\n"
        for r in points.orderBy("tp", "setup", "label").toLocalIterator():
            yield f'<ViewInterestPointsFile timepoint="{r["tp"]}" setup="{r["setup"]}" label={quoteattr(r["label"])} params={quoteattr(r["params"] or "")}>{text(r["path"])}</ViewInterestPointsFile>\n'
        yield "</ViewInterestPoints>\n<BoundingBoxes>\n"
        for r in boxes.orderBy("name").toLocalIterator():
            yield f'<BoundingBoxDefinition name={quoteattr(r["name"])}><min>{r["min_x"]} {r["min_y"]} {r["min_z"]}</min><max>{r["max_x"]} {r["max_y"]} {r["max_z"]}</max></BoundingBoxDefinition>\n'
        yield "</BoundingBoxes>\n<PointSpreadFunctions>\n"
        for r in psfs.orderBy("tp", "setup").toLocalIterator():
            yield f'<PointSpreadFunction timepoint="{r["tp"]}" setup="{r["setup"]}"><psf_file>{text(r["path"])}</psf_file></PointSpreadFunction>\n'
        yield "</PointSpreadFunctions>\n</SpimData>\n"

    with store.open_output_stream(at) as f:
        for line in lines():
            f.write(line.encode())


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a project's XML file, as write_project() takes them, and `timepoints`: tp of each. Sections that aren't there are empty."""
    x = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    part = lambda c, i, t: F.split(F.trim(F.col(c)), r"\s+")[i].cast(t)
    setups = x("ViewSetup", "id INT, size STRING, voxelSize STRUCT<unit:STRING, size:STRING>, attributes STRUCT<illumination:INT, channel:INT, tile:INT, angle:INT>")
    setups = setups.select(F.col("id").alias("setup"), *[f"attributes.{c}" for c in ("channel", "angle", "illumination", "tile")], *[part("size", i, "long").alias(f"s{c}") for i, c in enumerate("xyz")], *[part("voxelSize.size", i, "double").alias(f"v{c}") for i, c in enumerate("xyz")], "voxelSize.unit")
    maps = x("ViewRegistration", "_timepoint INT, _setup INT, ViewTransform ARRAY<STRUCT<_type:STRING, Name:STRING, affine:STRING>>")
    maps = maps.select(F.col("_timepoint").alias("tp"), F.col("_setup").alias("setup"), F.posexplode("ViewTransform").alias("ord", "t")).select("tp", "setup", "ord", F.col("t.Name").alias("name"), F.transform(F.split(F.trim("t.affine"), r"\s+"), lambda v: v.cast("double")).alias("m"))
    view = [F.col("_timepoint").alias("tp"), F.col("_setup").alias("setup")]
    boxes = x("BoundingBoxDefinition", "_name STRING, min STRING, max STRING").select(F.col("_name").alias("name"), *[part(e, i, "int").alias(f"{e}_{c}") for e in ("min", "max") for i, c in enumerate("xyz")])
    from lumiframe.functions import ranges

    times = x("Timepoints", "_type STRING, integerpattern STRING").select(F.explode(ranges.expand_ranges(F.col("integerpattern"))).alias("tp")).select(F.col("tp").cast("int").alias("tp"))
    return {
        "setups": setups,
        "registrations": maps,
        "missing": x("MissingView", "_timepoint INT, _setup INT, _VALUE STRING").select(*view),
        "boxes": boxes,
        "points": x("ViewInterestPointsFile", "_timepoint INT, _setup INT, _label STRING, _params STRING, _VALUE STRING").select(*view, F.col("_label").alias("label"), F.col("_params").alias("params"), F.col("_VALUE").alias("path")),
        "psfs": x("PointSpreadFunction", "_timepoint INT, _setup INT, psf_file STRING").select(*view, F.col("psf_file").alias("path")),
        "timepoints": times,
    }


def write_psfs(psfs: DataFrame, path: str) -> int:
    """Point spread functions (tp, setup, nx, ny, nz, data) as a TIFF stack each; returns how many."""
    from lumiframe.sources.images import write_tiff

    return write_tiff(psfs.withColumn("name", F.format_string("psf_t%d_s%d", "tp", "setup")), path)


def read_psfs(spark: SparkSession, path: str) -> DataFrame:
    """tp, setup, x, y, z, v of the point spread functions of a folder."""
    from lumiframe.sources import images

    images.register(spark)
    b = spark.read.format("tiffstack").option("path", path).load()
    number = lambda k: F.regexp_extract("array", r"psf_t(\d+)_s(\d+)\.tif$", k).cast("int")
    v = b.select(number(1).alias("tp"), number(2).alias("setup"), "nx", "oz", F.posexplode("data").alias("i", "v")).where("tp is not null")
    return v.select("tp", "setup", (F.col("i") % F.col("nx")).alias("x"), F.floor(F.col("i") / F.col("nx")).cast("int").alias("y"), F.col("oz").cast("int").alias("z"), "v")
