"""Classic public series, as (series_id, t, y) tables.

The values are fixed: they are the published series. Longer ones are read from a file with
read_series().
"""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.series import as_series

#: Fixed values.
#: Airline passengers, monthly from 1949.
AIRPASSENGERS = (
    112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140, 145, 150, 178, 163, 172,
    178, 199, 199, 184, 162, 146, 166, 171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194, 196, 196, 236, 235, 229, 243, 264, 272, 237, 211,
    180, 201, 204, 188, 235, 227, 234, 264, 302, 293, 259, 229, 203, 229, 242, 233, 267, 269, 270, 315, 364, 347, 312, 274, 237, 278, 284, 277, 317,
    313, 318, 374, 413, 405, 355, 306, 271, 306, 315, 301, 356, 348, 355, 422, 465, 467, 404, 347, 305, 336, 340, 318, 362, 348, 363, 435, 491, 505,
    404, 359, 310, 337, 360, 342, 406, 396, 420, 472, 548, 559, 463, 407, 362, 405, 417, 391, 419, 461, 472, 535, 622, 606, 508, 461, 390, 432,
)
#: Residents of Australia in thousands, quarterly from March 1971.
AUSTRES = (
    13067.3, 13130.5, 13198.4, 13254.2, 13303.7, 13353.9, 13409.3, 13459.2, 13504.5, 13552.6, 13614.3, 13669.5, 13722.6, 13772.1, 13832.0, 13862.6,
    13893.0, 13926.8, 13968.9, 14004.7, 14033.1, 14066.0, 14110.1, 14155.6, 14192.2, 14231.7, 14281.5, 14330.3, 14359.3, 14396.6, 14430.8, 14478.4,
    14515.7, 14554.9, 14602.5, 14646.4, 14695.4, 14746.6, 14807.4, 14874.4, 14923.3, 14988.7, 15054.1, 15121.7, 15184.2, 15239.3, 15288.9, 15346.2,
    15393.5, 15439.0, 15483.5, 15531.5, 15579.4, 15628.5, 15677.3, 15736.7, 15788.3, 15839.7, 15900.6, 15961.5, 16018.3, 16076.9, 16139.0, 16203.0,
    16263.3, 16327.9, 16398.9, 16478.3, 16538.2, 16621.6, 16697.0, 16777.2, 16833.1, 16891.6, 16956.8, 17026.3, 17085.4, 17106.9, 17169.4, 17239.4,
    17292.0, 17354.2, 17414.2, 17447.3, 17482.6, 17526.0, 17568.7, 17627.1, 17661.5,
)
#: Heart rate, every half second.
HEARTRATE = (
    84.2697, 84.2697, 84.0619, 85.6542, 87.2093, 87.1246, 86.8726, 86.7052, 87.5899, 89.1475, 89.8204, 89.8204, 90.4375, 91.7605, 93.1081, 94.3291,
    95.8003, 97.5119, 98.7457, 98.904, 98.3437, 98.3075, 98.8313, 99.0789, 98.8157, 98.2998, 97.7311, 97.6471, 97.7922, 97.2974, 96.2042, 95.2318,
    94.9367, 95.0867, 95.389, 95.5414, 95.2439, 94.9415, 95.3557, 96.3423, 97.1563, 97.4026, 96.7028, 96.5516, 97.9837, 98.9879, 97.6312, 95.4064,
    93.8603, 93.0552, 94.6012, 95.8476, 95.7692, 95.9236, 95.7692, 95.9211, 95.8501, 94.6703, 93.0993, 91.972, 91.7821, 91.7911, 90.807, 89.3196,
    88.1511, 88.7762, 90.2265, 90.8066, 91.2284, 92.4238, 93.243, 92.8472, 92.5926, 91.7778, 91.2974, 91.6364, 91.2952, 91.771, 93.2285, 93.3199,
    91.8799, 91.2239, 92.4055, 93.8716, 94.5825, 94.5594, 94.9453, 96.2412, 96.6879, 95.8295, 94.7819, 93.4731, 92.7997, 92.963, 92.6996, 91.9648,
    91.2417, 91.9312, 93.9548, 95.3044, 95.2511, 94.5358, 93.8093, 93.2287, 92.2065, 92.1588, 93.6376, 94.899, 95.1592, 95.2415, 95.5414, 95.0971,
    94.528, 95.5887, 96.4715, 96.6158, 97.0769, 96.8531, 96.3947, 97.4291, 98.1767, 97.0148, 96.044, 95.9581, 96.4814, 96.5211, 95.3629, 93.5741,
    92.077, 90.4094, 90.1751, 91.3312, 91.2883, 89.0592, 87.052, 86.6226, 85.7889, 85.6348, 85.3911, 83.8064, 82.8729, 82.6266, 82.645, 82.645,
    82.645, 82.645, 82.645, 82.645, 82.645, 82.645,
)
#: Lynx trapped in Canada, yearly from 1821.
LYNX = (
    269, 321, 585, 871, 1475, 2821, 3928, 5943, 4950, 2577, 523, 98, 184, 279, 409, 2285, 2685, 3409, 1824, 409, 151, 45, 68, 213, 546, 1033, 2129,
    2536, 957, 361, 377, 225, 360, 731, 1638, 2725, 2871, 2119, 684, 299, 236, 245, 552, 1623, 3311, 6721, 4254, 687, 255, 473, 358, 784, 1594, 1676,
    2251, 1426, 756, 299, 201, 229, 469, 736, 2042, 2811, 4431, 2511, 389, 73, 39, 49, 59, 188, 377, 1292, 4031, 3495, 587, 105, 153, 387, 758, 1307,
    3465, 6991, 6313, 3794, 1836, 345, 382, 808, 1388, 2713, 3800, 3091, 2985, 3790, 674, 81, 80, 108, 229, 399, 1132, 2432, 3574, 2935, 1537, 529,
    485, 662, 1000, 1590, 2657, 3396,
)
#: Sales of Australian wine, monthly from January 1980.
WINEIND = (
    15136, 16733, 20016, 17708, 18019, 19227, 22893, 23739, 21133, 22591, 26786, 29740, 15028, 17977, 20008, 21354, 19498, 22125, 25817, 28779, 20960,
    22254, 27392, 29945, 16933, 17892, 20533, 23569, 22417, 22084, 26580, 27454, 24081, 23451, 28991, 31386, 16896, 20045, 23471, 21747, 25621, 23859,
    25500, 30998, 24475, 23145, 29701, 34365, 17556, 22077, 25702, 22214, 26886, 23191, 27831, 35406, 23195, 25110, 30009, 36242, 18450, 21845, 26488,
    22394, 28057, 25451, 24872, 33424, 24052, 28449, 33533, 37351, 19969, 21701, 26249, 24493, 24603, 26485, 30723, 34569, 26689, 26157, 32064, 38870,
    21337, 19419, 23166, 28286, 24570, 24001, 33151, 24878, 26804, 28967, 33311, 40226, 20504, 23060, 23562, 27562, 23940, 24584, 34303, 25517, 23494,
    29095, 32903, 34379, 16991, 21109, 23740, 25552, 21752, 20294, 29009, 25500, 24166, 26960, 31222, 38641, 14672, 17543, 25453, 32683, 22449, 22316,
    27595, 25451, 25421, 25288, 32568, 35110, 16052, 22146, 21198, 19543, 22084, 23816, 29961, 26773, 26635, 26972, 30207, 38687, 16974, 21697, 24179,
    23757, 25013, 24019, 30345, 24488, 25156, 25650, 30923, 37240, 17466, 19463, 24352, 26805, 25236, 24735, 29356, 31234, 22724, 28496, 32857, 37198,
    13652, 22784, 23565, 26323, 23779, 27549, 29660, 23356,
)
#: Woollen yarn made in Australia, quarterly from March 1965.
WOOLYRNQ = (
    6172, 6709, 6633, 6660, 6786, 6800, 6730, 6765, 6720, 7133, 6946, 7095, 7047, 6757, 6915, 6921, 7064, 7206, 7190, 7402, 7819, 7300, 7105, 7259,
    7001, 7475, 6840, 7061, 5845, 7529, 7819, 6943, 5714, 6556, 7045, 5947, 5463, 6127, 5540, 4235, 3324, 4793, 5906, 5834, 5240, 5458, 5505, 5002,
    3999, 4826, 5318, 4681, 4442, 5305, 5466, 4995, 4573, 5081, 5696, 5079, 4373, 4986, 5341, 4800, 4161, 5007, 5464, 5127, 4240, 5338, 5129, 4437,
    3642, 4602, 5524, 4895, 4380, 5186, 6080, 5588, 5009, 5663, 6540, 6262, 5169, 5819, 6339, 5981, 4766, 5976, 6590, 5590, 5135, 5762, 6077, 5882,
    4247, 5264, 5146, 4868, 4329, 4869, 5127, 4868, 3827, 4987, 5222, 4928, 3930, 4469, 4954, 4752, 3888, 4588, 5309, 4732, 4837, 6135, 6396,
)

SERIES = {"airpassengers": AIRPASSENGERS, "austres": AUSTRES, "heartrate": HEARTRATE, "lynx": LYNX, "wineind": WINEIND, "woolyrnq": WOOLYRNQ}


#: First period of the series with a calendar.
STARTS = {"airpassengers": ("month", 1949), "austres": ("quarter", 1971), "lynx": ("year", 1821), "wineind": ("month", 1980), "woolyrnq": ("quarter", 1965)}


def labelled(df: DataFrame) -> DataFrame:
    """df of load() with a column ``label``: the year ("1821"), quarter ("Q1 1965") or month ("Jan 1980") of a row, or null."""
    label = F.lit(None).cast("string")
    for name, (kind, year) in STARTS.items():
        if kind == "year":
            text = (F.col("t") + year).cast("string")
        elif kind == "quarter":
            text = F.concat(F.lit("Q"), (F.col("t") % 4 + 1).cast("string"), F.lit(" "), (F.floor(F.col("t") / 4) + year).cast("string"))
        else:
            text = F.date_format(F.add_months(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.col("t").cast("int")), "MMM yyyy")
        label = F.when(F.col("series_id") == name, text).otherwise(label)
    return df.withColumn("label", label)


def load(spark: SparkSession, name: str) -> DataFrame:
    """A series by name."""
    if name not in SERIES:
        raise ValueError(f"{name!r} must be one of {sorted(SERIES)}; other series are read with read_series()")
    return spark.createDataFrame([(name, t, float(y)) for t, y in enumerate(SERIES[name])], "series_id string, t long, y double")


def read_series(spark: SparkSession, path: str, name: str, column: str | None = None, ts: str | None = None) -> DataFrame:
    """A series from one text file of numbers, or from a column of a CSV file with a header, ordered by its column ts."""
    if column is None:
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("t", "y"))
        return rows.select(F.lit(name).alias("series_id"), F.col("t").cast("long").alias("t"), F.col("y").cast("double").alias("y"))
    rows = spark.read.csv(path, header=True).select(F.lit(name).alias("series_id"), F.to_timestamp(ts).alias("ts"), F.col(column).cast("double").alias("y"))
    return as_series(rows, "ts")


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the first CSV member (with a header) of each tar archive of a path, plain or compressed.

    An archive is read by one task; a member must fit into a Python worker.
    """

    def members(frames):
        for pdf in frames:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    first = next((m for m in tar if m.isfile()), None)
                    if first is not None:
                        yield pd.DataFrame({"value": tar.extractfile(first).read().decode().splitlines()[1:]})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "value string")
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")
