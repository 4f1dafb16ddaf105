"""Files that cannot be read to their end: found by name, left out whole, and told.

Spark's own switch for corrupt files keeps the lines before the damage and names nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

SKIPPED = "file STRING, reason STRING"
_NAMED = re.compile(r"\[FAILED_READ_FILE[^\]]*\][^\n]*?reading file (.+?)\.\s+(?:[^\n]*?)SQLSTATE")


def _plain(name: str) -> str:
    """A local file has one or three slashes after its scheme, depending on who names it."""
    return re.sub(r"^file:/+", "file:/", name)


def unreadable_file(error: Exception) -> tuple[str, str] | None:
    """Name and reason of the file that ended a job; None if the job ended for another reason."""
    told = str(error)
    named = _NAMED.search(told)
    if named is None:
        return None
    causes = re.findall(r"Caused by: ([^\n]+)", told)
    return _plain(named.group(1)), (causes[-1] if causes else named.group(0)).strip()


def without_files(lines: DataFrame, files) -> DataFrame:
    """``lines`` (with ``_file``) without some files; they are pruned from the scan, not read and dropped."""
    names = sorted({name for f in files for name in (f, f.replace("file:/", "file:///", 1))})
    return lines.filter(~F.col("_file").isin(names)) if names else lines


def find_unreadable(lines: DataFrame, known: tuple[str, str] | None = None) -> dict[str, str]:
    """Name and reason of every file of the scan ``lines`` (``value``, ``_file``) that cannot be read to its end.

    A job over a share of the files names one bad file or none.  After a bad one it is left out and the share is
    halved by a hash of the names, so sound shares are read once more and not again.  The driver holds the
    names of the bad files only, and runs at most two jobs for each.
    """
    bad = dict([known]) if known else {}
    shares = [(1, 0)]
    while shares:
        of, part = shares.pop()
        share = without_files(lines, bad).filter(F.pmod(F.xxhash64("_file"), F.lit(of)) == part)
        try:
            share.agg(F.sum(F.length("value"))).collect()
        except Exception as error:
            named = unreadable_file(error)
            if named is None or named[0] in bad:
                raise
            bad[named[0]] = named[1]
            shares += [(2 * of, part), (2 * of, part + of)]
    return bad


def skipped_table(spark: SparkSession, bad: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(bad.items()), SKIPPED)
