"""Table sources: JDBC, Parquet, CSV, REST; transfers and laundering patterns of a transaction graph."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.config import ApiConfig, CsvConfig, JdbcConfig
from quaylight.contract import AMOUNTS
from quaylight.functions.columns import nan_to_null


class IngestionError(Exception):
    """A source can't be read."""


def jdbc_url(config: JdbcConfig) -> str:
    if not config.trusted_connection:
        raise IngestionError("only trusted connections are supported")
    return f"jdbc:sqlserver://{config.server};databaseName={config.database};integratedSecurity=true"


def to_usd(df: DataFrame, multiplier: float) -> DataFrame:
    """Amount columns in dollars."""
    return df.withColumns({c: F.col(c) * F.lit(multiplier) for c in AMOUNTS if c in df.columns})


def limited(df: DataFrame, limit: int | None, order: list[str] | None = None) -> DataFrame:
    """The first `limit` rows; with an order they are always the same."""
    if limit is None:
        return df
    if limit <= 0:
        raise ValueError("limit must be positive")
    return (df.orderBy(*order) if order else df).limit(limit)


def read_jdbc(spark: SparkSession, config: JdbcConfig, limit: int | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """The payments table in dollars. partition: (column, lower, upper, partitions) for a parallel scan."""
    url = jdbc_url(config)
    options = {"url": url, "dbtable": config.table, "driver": config.driver, "fetchsize": str(config.fetch_size)}
    if partition:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition)))
    try:
        df = spark.read.format("jdbc").options(**options).load()
    except Exception as e:
        raise IngestionError(f"cannot read {config.table}: {e}") from e
    return to_usd(nan_to_null(limited(df, limit)), config.amount_unit_multiplier)


def read_payments(spark: SparkSession, path: str, multiplier: float = 1.0, limit: int | None = None) -> DataFrame:
    """A payments table from Parquet; only the columns that a query uses are read."""
    return to_usd(nan_to_null(limited(spark.read.parquet(path), limit)), multiplier)


def read_csv(spark: SparkSession, config: CsvConfig, schema: str | None = None) -> DataFrame:
    """A delimited file. Missing, non-file, empty, malformed and badly encoded input is an IngestionError."""
    path = spark._jvm.org.apache.hadoop.fs.Path(config.path)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        raise IngestionError(f"no such file: {config.path}")
    status = system.getFileStatus(path)
    if status.isDirectory():
        raise IngestionError(f"not a file: {config.path}")
    if not status.getLen():
        raise IngestionError(f"empty file: {config.path}")
    if config.split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", config.split_bytes)
    reader = spark.read.option("sep", config.delimiter).option("encoding", config.encoding).option("header", config.header).option("mode", "FAILFAST").option("enforceSchema", "false")
    try:
        return nan_to_null((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(config.path))
    except Exception as e:
        raise IngestionError(f"cannot read {config.path}: {e}") from e


RETRIED = (500, 502, 503, 504)
DATA_KEYS = ("data", "records", "results", "transactions", "items")


def shape(data: object, config: ApiConfig) -> list[dict]:
    """Rows of a JSON answer: a list; the configured or first known key of an object; or the object itself."""
    if isinstance(data, list):
        return data
    if not isinstance(data, dict):
        raise IngestionError(f"unexpected answer from {config.url}: {type(data).__name__}")
    if config.data_key is not None:
        if config.data_key not in data:
            raise IngestionError(f"no key {config.data_key} in the answer from {config.url}")
        return data[config.data_key]
    return next((data[k] for k in DATA_KEYS if k in data), [data])


def fetch(config: ApiConfig) -> object:
    """The parsed answer; server errors are retried with growing pauses."""
    url = config.url + (("&" if "?" in config.url else "?") + urllib.parse.urlencode(config.params) if config.params else "")
    for attempt in range(config.retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=config.headers), timeout=config.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt == config.retries:
                raise IngestionError(f"HTTP {e.code} from {config.url}") from e
        except TimeoutError as e:
            raise IngestionError(f"timeout from {config.url}") from e
        except urllib.error.URLError as e:
            raise IngestionError(f"cannot connect to {config.url}: {e.reason}") from e
        except ValueError as e:
            raise IngestionError(f"invalid JSON from {config.url}") from e
        time.sleep(config.backoff_factor * 2**attempt)
    raise AssertionError


def read_api(spark: SparkSession, config: ApiConfig, schema: str | None = None) -> DataFrame:
    """Rows of a REST answer. An empty answer needs a schema."""
    rows = shape(fetch(config), config)
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    if schema is None:
        return nan_to_null(spark.read.json(lines.rdd.map(lambda r: r.value))) if rows else spark.createDataFrame([], "value string")
    return nan_to_null(lines.select(F.from_json("value", schema).alias("r")).select("r.*"))


#: Columns of the transfers file by place; its header names two of them alike.
TRANSFERS = "timestamp string, from_bank string, from_account string, to_bank string, to_account string, amount_received double, receiving_currency string, amount_paid double, payment_currency string, payment_format string, is_laundering int"


def node(bank: str, account: str):
    return F.concat(F.col(bank), F.lit("_"), F.col(account))


def read_transfers(spark: SparkSession, path: str, limit: int | None = None, drop_self_transfers: bool = True) -> DataFrame:
    """(timestamp, from_node, to_node, amount_paid, payment_format, is_laundering); banks and accounts keep leading zeros."""
    rows = limited(spark.read.schema(TRANSFERS).option("header", True).option("enforceSchema", True).csv(path), limit)
    out = rows.select(F.to_timestamp("timestamp", "yyyy/MM/dd HH:mm").alias("timestamp"), node("from_bank", "from_account").alias("from_node"), node("to_bank", "to_account").alias("to_node"), "amount_paid", "payment_format", "is_laundering")
    return out.where("from_node <> to_node") if drop_self_transfers else out


def parse_patterns(lines: DataFrame, block: int = 100_000) -> DataFrame:
    """(attempt_id, typology, timestamp, from_node, to_node, amount_paid) of pattern lines (line_no, value).

    A BEGIN line opens an attempt, numbered from 0; other lines but END ones and blanks are its transfers. Lines are ordered
    within blocks of `block` numbers only; a scan over one row for each block carries attempts across their borders.
    """
    said = lines.select("line_no", F.trim("value").alias("value")).withColumn("block", F.floor(F.col("line_no") / block))
    begin = F.col("value").startswith("BEGIN LAUNDERING ATTEMPT")
    said = said.withColumn("begin", begin.cast("int")).withColumn("found", F.when(begin, F.regexp_extract("value", "BEGIN LAUNDERING ATTEMPT - ([A-Z-]+)", 1)))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = said.groupBy("block").agg(F.sum("begin").alias("n"), F.max_by("found", F.when(F.col("begin") == 1, F.col("line_no"))).alias("last"))
    carried = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.last("last", True).over(before).alias("carry"))
    order = Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = said.select("block", "value", F.sum("begin").over(order).alias("k"), F.last("found", True).over(order).alias("own")).join(carried, "block")
    marked = own.select("value", (F.col("base") + F.col("k") - 1).alias("attempt_id"), F.coalesce("own", "carry").alias("typology"))
    part = F.split("value", ",")
    return marked.where("value <> '' and not startswith(value, 'BEGIN') and not startswith(value, 'END') and attempt_id >= 0").select(
        F.col("attempt_id").cast("long").alias("attempt_id"), "typology", F.to_timestamp(part[0], "yyyy/MM/dd HH:mm").alias("timestamp"),
        F.concat_ws("_", part[1], part[2]).alias("from_node"), F.concat_ws("_", part[3], part[4]).alias("to_node"), part[7].cast("double").alias("amount_paid"),
    )


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return parse_patterns(text.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")))
