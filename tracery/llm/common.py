"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracery.plans.scratch import forget as forget
from tracery.plans.scratch import scratch_dir as scratch_dir
from tracery.plans.scratch import written as written

#: Word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
