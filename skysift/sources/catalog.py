"""Product catalogue: XML metadata, band inventory, quarantine reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.constants import BANDS, RESOLUTIONS

PRODUCT_SCHEMA = """
  General_Info struct<
    Product_Info: struct<PRODUCT_URI: string, PROCESSING_LEVEL: string, PROCESSING_BASELINE: string, GENERATION_TIME: string,
      PRODUCT_START_TIME: string, Datatake: struct<SPACECRAFT_NAME: string>>,
    Product_Image_Characteristics: struct<
      Special_Values: array<struct<SPECIAL_VALUE_TEXT: string, SPECIAL_VALUE_INDEX: double>>,
      QUANTIFICATION_VALUE: struct<_VALUE: double, _unit: string>,
      Radiometric_Offset_List: struct<RADIO_ADD_OFFSET: array<struct<_VALUE: double, _band_id: int>>>>>,
  Geometric_Info struct<Product_Footprint: struct<Product_Footprint: struct<Global_Footprint: struct<EXT_POS_LIST: string>>>>,
  Quality_Indicators_Info struct<Cloud_Coverage_Assessment: double, Snow_Coverage_Assessment: double>
"""
GRANULE_SCHEMA = """
  General_Info struct<SENSING_TIME: string>,
  Geometric_Info struct<
    Tile_Geocoding: struct<HORIZONTAL_CS_CODE: string,
      Size: array<struct<_resolution: int, NROWS: int, NCOLS: int>>,
      Geoposition: array<struct<_resolution: int, ULX: double, ULY: double, XDIM: double, YDIM: double>>>,
    Tile_Angles: struct<Mean_Sun_Angle: struct<ZENITH_ANGLE: struct<_VALUE: double, _unit: string>, AZIMUTH_ANGLE: struct<_VALUE: double, _unit: string>>>>
"""
# The product folder is the last *.SAFE element of a file's path.
PRODUCT_PATTERN = r"([^/=]+\.SAFE)(?:/|$)"
BAND_PATTERN = r"_(B\d[0-9A])\.jp2"


def _documents(spark: SparkSession, source: str | DataFrame, tag: str, schema: str) -> DataFrame:
    """Parsed documents with their product; ``source`` is a path of product folders or a table (product, value)."""
    if isinstance(source, DataFrame):
        options = {"rowTag": tag, "ignoreNamespace": "true", "mode": "PERMISSIVE"}
        return source.select("product", F.from_xml("value", schema, options).alias("_d")).select("_d.*", "product")
    path = source
    found = (
        spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", "true").option("mode", "PERMISSIVE").load(path)
    )
    return found.select("*", F.regexp_extract(F.col("_metadata.file_path"), PRODUCT_PATTERN, 1).alias("product"))


def scan_products(
    spark: SparkSession, product_path: str | DataFrame, granule_path: str | DataFrame, folders: DataFrame | None = None,
) -> DataFrame:
    """Raw metadata, one row per product: the product document and its granules.

    Each kind of document is read once, with a fixed schema, from product folders or
    from a table (product, value) of collected documents, which costs no file a
    product. A product with any
    document, or named in ``folders`` (product), has a row; what it lacks is NULL.
    """
    products = _documents(spark, product_path, "Level-1C_User_Product", PRODUCT_SCHEMA).select(
        "product", F.col("General_Info.Product_Info").alias("info"), F.col("General_Info.Product_Image_Characteristics").alias("image"),
        F.col("Geometric_Info.Product_Footprint.Product_Footprint.Global_Footprint.EXT_POS_LIST").alias("positions"),
        F.col("Quality_Indicators_Info").alias("quality"))
    granules = _documents(spark, granule_path, "Level-1C_Tile_ID", GRANULE_SCHEMA).groupBy("product").agg(
        F.count(F.lit(1)).alias("granules"),
        F.min_by(F.struct(
            F.col("General_Info.SENSING_TIME").alias("sensing"), F.col("Geometric_Info.Tile_Geocoding").alias("geo"),
            F.col("Geometric_Info.Tile_Angles.Mean_Sun_Angle").alias("sun")), F.col("General_Info.SENSING_TIME")).alias("granule"))
    found = products.join(granules, "product", "full")
    return found if folders is None else folders.select("product").distinct().join(found, "product", "full")


def _offsets(listed: Column) -> Column:
    """Band -> offset; every band is 0 where the product lists none."""
    names = F.array(*[F.lit(b) for b in BANDS])
    given = F.map_from_entries(F.transform(listed, lambda o: F.struct(F.get(names, o["_band_id"]).alias("key"), o["_VALUE"].alias("value"))))
    none = F.map_from_arrays(names, F.array_repeat(F.lit(0.0), len(BANDS)))
    return F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, given).otherwise(none)


def _by_resolution(items: Column, *fields: str) -> Column:
    return F.map_from_entries(F.transform(items, lambda s: F.struct(
        s["_resolution"].alias("key"), F.struct(*[s[f].alias(f.lower()) for f in fields]).alias("value"))))


def _special(values: Column, name: str, default: int) -> Column:
    hit = F.filter(values, lambda v: v["SPECIAL_VALUE_TEXT"] == name)
    return F.coalesce(F.get(hit, 0)["SPECIAL_VALUE_INDEX"].cast("int"), F.lit(default))


def _footprint(text: Column) -> Column:
    """'lat lon lat lon ...' -> array of (lat, lon)."""
    numbers = F.transform(F.split(F.trim(text), r"\s+"), lambda t: t.cast("double"))
    pairs = F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: F.struct(F.get(numbers, 2 * i).alias("lat"), F.get(numbers, 2 * i + 1).alias("lon")))


def product_catalog(raw: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Typed metadata; with ``quality`` (product, ok) of the products that passed only."""
    if quality is not None:
        raw = raw.join(quality.filter("ok").select("product"), "product", "left_semi")
    info, image, geo = F.col("info"), F.col("image"), F.col("granule.geo")
    listed = image["Radiometric_Offset_List"]["RADIO_ADD_OFFSET"]
    return raw.select(
        "product",
        F.coalesce(info["PRODUCT_URI"], F.col("product")).alias("product_uri"),
        info["PROCESSING_LEVEL"].alias("processing_level"),
        F.coalesce(info["PROCESSING_BASELINE"], F.lit("")).alias("processing_baseline"),
        F.coalesce(info["Datatake"]["SPACECRAFT_NAME"], F.lit("")).alias("spacecraft"),
        F.to_timestamp(F.coalesce(F.col("granule.sensing"), info["PRODUCT_START_TIME"])).alias("sensing_time"),
        F.to_timestamp(info["GENERATION_TIME"]).alias("generation_time"),
        F.regexp_extract(geo["HORIZONTAL_CS_CODE"], r"(\d+)$", 1).cast("int").alias("epsg"),
        _by_resolution(geo["Size"], "NROWS", "NCOLS").alias("sizes"),
        _by_resolution(geo["Geoposition"], "ULX", "ULY", "XDIM", "YDIM").alias("geoposition"),
        image["QUANTIFICATION_VALUE"]["_VALUE"].alias("quantification_value"),
        _offsets(listed).alias("radio_add_offset"),
        (F.coalesce(F.size(listed), F.lit(0)) > 0).alias("has_radiometric_offset"),
        _special(image["Special_Values"], "NODATA", 0).alias("nodata_value"),
        _special(image["Special_Values"], "SATURATED", 65535).alias("saturated_value"),
        F.coalesce(F.col("quality.Cloud_Coverage_Assessment"), F.lit(0.0)).alias("cloud_coverage_assessment"),
        F.coalesce(F.col("quality.Snow_Coverage_Assessment"), F.lit(0.0)).alias("snow_coverage_assessment"),
        F.col("granule.sun.ZENITH_ANGLE._VALUE").alias("mean_sun_zenith"),
        F.col("granule.sun.AZIMUTH_ANGLE._VALUE").alias("mean_sun_azimuth"),
        _footprint(F.col("positions")).alias("footprint"),
    )


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder. File contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def band_inventory(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """Files of each product: band, native path, size; from a folder, or from a stored listing (path, length)."""
    listing = files if isinstance(files, DataFrame) else listed_files(spark, files)
    found = listing.select(
        F.regexp_extract("path", PRODUCT_PATTERN, 1).alias("product"), F.regexp_extract("path", BAND_PATTERN, 1).alias("band"), "path", "length")
    return found.filter((F.col("band") != "") & (F.col("product") != ""))


def missing_bands(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Bands of the instrument that a product lacks."""
    wanted = products.select("product", F.explode(F.array(*[F.lit(b) for b in BANDS])).alias("band"))
    return wanted.join(inventory.select("product", "band"), ["product", "band"], "left_anti")


def catalog_quality(raw: DataFrame, lacking: DataFrame) -> DataFrame:
    """Why a product cannot be used; an empty list means it can."""
    geo = F.col("granule.geo")
    resolutions = F.array_intersect(
        F.transform(geo["Size"], lambda s: s["_resolution"]), F.transform(geo["Geoposition"], lambda s: s["_resolution"]))
    complete = F.size(F.array_intersect(resolutions, F.array(*[F.lit(r) for r in RESOLUTIONS]))) == len(RESOLUTIONS)
    absent = lacking.groupBy("product").agg(F.array_join(F.array_sort(F.collect_set("band")), ",").alias("absent"))
    has_product, has_granule = F.col("info").isNotNull(), F.col("granules").isNotNull()
    of_product, of_granule = (lambda bad: has_product & bad), (lambda bad: has_granule & bad)
    rules = [
        (~has_product, "product document missing"), (~has_granule, "granule document missing"),
        (of_product(~F.coalesce(F.col("info.PROCESSING_LEVEL"), F.lit("")).contains("Level-1C")), "not Level-1C"),
        (of_product(F.col("image.QUANTIFICATION_VALUE._VALUE").isNull()), "quantification missing"),
        (of_granule(F.coalesce("granules", F.lit(0)) != 1), "granule count is not 1"),
        (of_granule(~F.coalesce(complete, F.lit(False))), "resolution missing"),
        (of_granule(~F.coalesce(geo["HORIZONTAL_CS_CODE"].rlike(r"\d+$"), F.lit(False))), "EPSG code not found"),
        (of_granule(F.col("granule.sun.ZENITH_ANGLE._VALUE").isNull()), "sun angle missing"),
        (of_product(F.coalesce(F.length(F.trim("positions")), F.lit(0)) == 0), "footprint missing"),
        (F.col("absent").isNotNull(), "band missing"),
    ]
    reasons = F.filter(F.array(*[F.when(bad, text) for bad, text in rules]), lambda r: r.isNotNull())
    return raw.join(absent, "product", "left").select("product", reasons.alias("reasons"), (F.size(reasons) == 0).alias("ok"))
