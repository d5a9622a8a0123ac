"""Text logs as a sink and a source.

Lines follow the reference's format ``"%(name)s %(levelname)s
%(asctime)-15s: %(message)s"`` with Python's ``asctime``
(``YYYY-mm-dd HH:MM:SS,mmm``, milliseconds truncated).  As in the
reference, a message with a line feed becomes two lines, of which the second
does not parse; render such messages with the feed replaced.

A log that is read by level is stored in one folder a level number
(:func:`write_by_level`, :func:`stream_by_level`): a threshold then reads only
the folders at or above it (:func:`read_by_level`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Python logging level names and numbers.
LEVELS = {"CRITICAL": 50, "ERROR": 40, "WARNING": 30, "INFO": 20, "DEBUG": 10, "NOTSET": 0}
DEFAULT_LEVEL = 40  # the reference's default threshold (ERROR)
DEBUG_LEVEL = 10    # threshold with the debug flag on
NO_LEVEL = -1       # folder of lines without a known level

LINE_PATTERN = r"^(\S+) ([A-Z]+) (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) *: (.*)$"


def level_number(level_name: str | Column) -> Column:
    """Level name to number (unknown names give null)."""
    c = F.col(level_name) if isinstance(level_name, str) else level_name
    mapping = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(mapping, c)


def asctime(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss,SSS")


def render_lines(df: DataFrame, name: str | Column, level: str | Column, ts: str | Column,
                 message: str | Column) -> DataFrame:
    """S6 write side: one ``value`` line per record."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(F.format_string("%s %s %-15s: %s", col(name), col(level), asctime(ts),
                                     col(message)).alias("value"))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """S6 read side: split each line into ``logger``, ``level``,
    ``levelno``, ``asctime``, ``ts`` and ``message``; lines that do not
    match get nulls."""
    v = F.col(value)
    ok = v.rlike(LINE_PATTERN)
    # The pattern is tested once; what matches is cut by place.
    words = F.split(v, " ", 4)
    rest = F.get(words, F.lit(3))  # time, blanks, colon, message
    parts = {
        "logger": F.get(words, F.lit(0)),
        "level": F.get(words, F.lit(1)),
        "asctime": F.concat(F.get(words, F.lit(2)), F.lit(" "), F.substring(rest, 1, 12)),
        "message": F.substring(F.ltrim(F.substring(rest, F.lit(13), F.length(rest))), F.lit(3), F.length(rest)),
    }
    out = lines.select(*[F.when(ok, c).alias(k) for k, c in parts.items()])
    return out.withColumns({
        "levelno": level_number("level"),
        "ts": F.to_timestamp_ntz(F.col("asctime"), F.lit("yyyy-MM-dd HH:mm:ss,SSS")),
    })


def lines_at(lines: DataFrame, threshold: int = DEFAULT_LEVEL, value: str = "value") -> DataFrame:
    """F7 on unparsed lines: those whose second word is a level at or above
    the threshold."""
    return lines.where(level_number(F.split_part(F.col(value), F.lit(" "), F.lit(2))) >= F.lit(threshold))


def level_filter(df: DataFrame, threshold: int = DEFAULT_LEVEL, level: str = "levelno") -> DataFrame:
    """records at or above the threshold."""
    return df.where(F.col(level) >= F.lit(threshold))


def _by_level(lines: DataFrame) -> DataFrame:
    number = level_number(F.split_part(F.col("value"), F.lit(" "), F.lit(2)))
    return lines.select("value", F.coalesce(number, F.lit(NO_LEVEL)).alias("levelno"))


def write_by_level(lines: DataFrame, path: str, batch: int = 0) -> None:
    """S6 sink: text files in folders ``batch=<batch>/levelno=<number>``; lines
    without a known level go to the folder of ``NO_LEVEL``.  Writing a batch
    again replaces it."""
    _by_level(lines).write.mode("overwrite").partitionBy("levelno").text(f"{path}/batch={batch}")


def stream_by_level(lines: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """:func:`write_by_level` for a stream of lines, a folder a micro-batch; a
    replayed batch replaces its own."""
    writer = (lines.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda rows, batch: write_by_level(rows, path, batch)))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def read_by_level(spark: SparkSession, path: str, threshold: int = DEFAULT_LEVEL) -> DataFrame:
    """F7 on a stored log: its ``value`` lines at or above the threshold.  The
    folder's number is compared, so lines below it are not read."""
    lines = spark.read.schema("value string, batch long, levelno int").text(path)
    return lines.where(F.col("levelno") >= F.lit(threshold)).select("value")


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S6 sink: plain text files, one line per record."""
    lines.select("value").write.mode(mode).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S6 source: text files as a ``value`` column."""
    return spark.read.text(path)
