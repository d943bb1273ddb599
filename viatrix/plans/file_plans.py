"""Queries that write files of the domain's dialects and read them again (S1, S2, S4, S7, S9-S13), and network variants (S15)."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from viatrix.operators import network as N
from viatrix.plans import domain as D
from viatrix.plans.registry import register
from viatrix.session import table
from viatrix.sources import readers

C = F.col


def schema(**kinds):
    return StructType([StructField(k, v()) for k, v in kinds.items()])


@register("s1_swiss_csv", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_name || ' ü' END AS s_name, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def s1(s, d):
    """Semicolons, decimal commas, marks between thousands, Latin letters in one byte, and sentinels for nothing."""
    amount = F.translate(F.format_number("s_acctbal", 2), ",.", "',")
    x = table(s, d, "supplier").select("s_suppkey", F.when(C("s_suppkey") % 7 == 0, "[-99]").otherwise(F.concat("s_name", F.lit(" ü"))).alias("s_name"), F.when(C("s_suppkey") % 5 == 0, "nan").otherwise(amount).alias("s_acctbal"))
    x.write.csv(path := readers.scratch(s, "swiss"), sep=";", header=True, encoding="ISO-8859-1")
    return readers.read_swiss_csv(s, path, schema(s_suppkey=LongType, s_name=StringType, s_acctbal=DoubleType))


@register("s2_plain_csv", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def s2(s, d):
    table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.csv(path := readers.scratch(s, "plain"), header=True)
    return readers.read_csv(s, path, schema(c_custkey=LongType, c_mktsegment=StringType, c_acctbal=DoubleType))


@register("s4_workbook_sheet", "SELECT n_nationkey, n_name, n_regionkey * 1.5 AS share FROM nation")
def s4(s, d):
    """A sheet whose table begins below five lines of remarks; the workbook has another sheet too."""
    rows = [[r.n_nationkey, r.n_name, r.n_regionkey * 1.5, "remark"] for r in table(s, d, "nation").collect()]  # 25 stations
    sheets = {"Notes": [["nothing here"]], "Population": [["remarks"], [], ["more"], [], [], ["n_nationkey", "n_name", "share", "other"], *rows]}
    readers.write_workbook(s, path := f"{readers.scratch(s, 'workbook')}/communes.xlsx", sheets)
    return readers.read_workbook(s, path, "Population", schema(n_nationkey=LongType, n_name=StringType, share=DoubleType), 5)


@register("s4_workbook_folder", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def s4_folder(s, d):
    """A workbook for each nation and 20,000 customers, written and read by tasks."""
    k = C("c_custkey")
    x = table(s, d, "customer").select("c_custkey", "c_name", F.when(k % 7 != 0, C("c_acctbal")).alias("c_acctbal"), "c_nationkey")
    readers.write_workbooks(x, path := readers.scratch(s, "workbooks"), "Population", F.concat_ws("_", F.lit("nation"), "c_nationkey", F.floor(k / 20000)), 5)
    return readers.read_workbook(s, f"{path}/*.xlsx", "Population", schema(c_custkey=LongType, c_name=StringType, c_acctbal=DoubleType), 5)


@register("s7_elevation_grid", f'WITH {D.CELLS}, o AS (SELECT min("row") AS r, min(col) AS c FROM cells) SELECT 2600000.0 + "row" * 10 AS x, 1200000.0 + col * 10 AS y, round(value, 3) AS z FROM cells, o WHERE ("row" - r) % 5 = 0 AND (col - c) % 5 = 0')
def s7(s, d):
    """Points of a ten-metre model, of which every fifth row and column is read."""
    x = D.cells(s, d).select((2600000.0 + C("row") * 10).alias("x"), (1200000.0 + C("col") * 10).alias("y"), F.round("value", 3).alias("z"))
    x.write.csv(path := readers.scratch(s, "elevation"), sep=" ", header=True)
    return readers.read_elevation(s, path, 50)


@register("s9_id_from_file_name", "SELECT p_partkey, p_retailprice, regexp_extract(p_brand, '[0-9]+')::INT AS dev FROM part")
def s9(s, d):
    """A file for each development, whose number stands in the file's name alone."""
    name = F.concat(F.lit("od_matrix_dev"), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit("_medium.csv"))
    x = table(s, d, "part").select("p_partkey", "p_retailprice", name.alias("file"))
    x.repartition("file").write.partitionBy("file").csv(path := readers.scratch(s, "numbered"), header=True)
    return readers.read_numbered(s, f"{path}/*", r"dev(\d+)_", "dev", header=True, schema="p_partkey long, p_retailprice double")


@register("s10_cached_table", f"WITH {D.PANEL} SELECT district, year, round(value, 2) AS value, 1 AS built FROM panel")
def s10(s, d):
    """Built when asked for first, read after that, and built again when the cache is not to be used."""
    path, calls = readers.scratch(s, "cache"), []

    def build():
        calls.append(1)
        return D.panel(s, d)

    for use in (True, True):
        out = readers.cached(s, path, build, use)
    return out.select("district", "year", F.round("value", 2).alias("value"), F.lit(len(calls)).alias("built"))


@register("s11_file_for_each", f"WITH {D.NET} SELECT k AS dev_id, u, v, tt + k AS tt FROM edges CROSS JOIN range(4) r(k) WHERE k <> 2")
def s11(s, d):
    """Development networks in a folder each; one of them is taken out by its folder."""
    x = D.net(s, d).withColumn("dev_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("tt", C("tt") + C("dev_id"))
    readers.write_each(x, path := readers.scratch(s, "each"), "dev_id")
    return s.read.option("basePath", path).parquet(*[f"{path}/dev_id={k}" for k in (0, 1, 3)]).select(C("dev_id").cast("long").alias("dev_id"), "u", "v", "tt")


S12 = """WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'AK_2035' WHEN 1 THEN 'AK_2035_extended' WHEN 2 THEN 'current' WHEN 3 THEN '2024_extended' ELSE 'AK_2050' END AS network FROM orders)
SELECT o_orderkey, network, CASE WHEN network = 'AK_2050' THEN 'no network' ELSE 'services_' || lower(network) END AS source FROM n"""


@register("s12_network_selector", S12)
def s12(s, d):
    """The services table that each order's network stands for; an unknown name has none."""
    names = F.array(*map(F.lit, ("AK_2035", "AK_2035_extended", "current", "2024_extended", "AK_2050")))
    x = table(s, d, "orders").select("o_orderkey", F.get(names, (C("o_orderkey") % 5).cast("int")).alias("network"))
    return x.select("o_orderkey", "network", F.coalesce(readers.network_source(C("network")), F.lit("no network")).alias("source"))


@register("s13_result_paths", "SELECT label, CASE WHEN regexp_matches(label, 'dev [0-9]+') THEN 'out/developments/dev_id=' || regexp_extract(label, 'dev ([0-9]+)', 1) WHEN label LIKE '%enhanced%' THEN 'out/enhanced/network=' || replace(replace(label, ' ', '_'), '#', '_') ELSE 'out/baseline/network=' || replace(replace(label, ' ', '_'), '#', '_') END AS path FROM (SELECT DISTINCT p_brand || CASE p_size % 3 WHEN 0 THEN ' dev ' || p_size WHEN 1 THEN '_enhanced' ELSE '' END AS label FROM part)")
def s13(s, d):
    size = C("p_size")
    labels = table(s, d, "part").select(F.concat("p_brand", F.when(size % 3 == 0, F.concat(F.lit(" dev "), size)).when(size % 3 == 1, "_enhanced").otherwise("")).alias("label")).distinct()
    return labels.select("label", readers.place_of("out/", C("label")).alias("path"))


#: edits of the named variants: action, service, from, to, value
EDITS = {
    "AK_2035": [("scale", "AF", None, None, 2.0), ("drop", "NF", None, None, None), ("add", "G", 3, 12, 2.0), ("add", "G", 12, 3, 2.0)],
    "AK_2035_extended": [("scale", "AF", None, None, 2.0), ("drop", "NF", None, None, None), ("drop", "RF", 4, 5, None), ("add", "P", 1, 8, 1.0), ("add", "C", 8, 20, 4.0)],
    "2024_extended": [("drop", "X", 0, 1, None), ("scale", "NO", None, None, 0.5), ("add", "S18", 2, 17, 2.0)],
}


@register("s15_network_edits", f"""WITH {D.SERVICES}, k AS (SELECT * FROM (VALUES ('AK_2035'), ('AK_2035_extended'), ('2024_extended')) r(variant))
SELECT variant, from_node, to_node, service, frequency * CASE WHEN variant LIKE 'AK%' AND service = 'AF' THEN 2.0 WHEN variant = '2024_extended' AND service = 'NO' THEN 0.5 ELSE 1.0 END AS frequency FROM services CROSS JOIN k
WHERE NOT (variant LIKE 'AK%' AND service = 'NF') AND NOT (variant = 'AK_2035_extended' AND service = 'RF' AND from_node = 4 AND to_node = 5) AND NOT (variant = '2024_extended' AND service = 'X' AND from_node = 0 AND to_node = 1)
UNION ALL SELECT * FROM (VALUES ('AK_2035', 3, 12, 'G', 2.0), ('AK_2035', 12, 3, 'G', 2.0), ('AK_2035_extended', 1, 8, 'P', 1.0), ('AK_2035_extended', 8, 20, 'C', 4.0), ('2024_extended', 2, 17, 'S18', 2.0)) r(v, a, b, s, f)""")
def s15(s, d):
    rows = [(variant, *edit) for variant, edits in EDITS.items() for edit in edits]
    return N.edited(D.services(s, d), s.createDataFrame(rows, "variant string, action string, service string, from_node int, to_node int, value double"))
