"""Parsers as steps over columns, each of which may use what earlier steps found.

Catalyst inlines an expression wherever it is used, so a parser that looks at an intermediate result
ten times would compute it ten times. `let` binds such results inside one expression, which is
interpreted. Laid out over columns every intermediate result is a column of its own: Spark keeps
projections apart whose results are used more than once, and generates code for them. That is for
results which are only shown: a filter on one is pushed below the projections and takes all its
steps into one expression, many times over.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Found = Callable[[str], Column]
Step = Callable[[Found], Mapping[str, Column]]
#: A parser: its steps, the last of which gives the one value `out`.
Steps = Sequence[Step]


def with_columns(df: DataFrame, jobs: Mapping[str, tuple[Steps, Mapping[str, Column]]]) -> DataFrame:
    """`df` with a column of each job's name; all jobs take their steps side by side.

    The columns of the steps in between are dropped. Their names begin with two underscores and the job's name.
    """
    name = lambda job, n: f"__{job}__{n}"
    out = df.withColumns({name(job, n): c for job, (_, inputs) in jobs.items() for n, c in inputs.items()})
    for level in range(max((len(steps) for steps, _ in jobs.values()), default=0)):
        made = {}
        for job, (steps, _) in jobs.items():
            if level < len(steps):
                made |= {name(job, n): c for n, c in steps[level](lambda n, job=job: F.col(name(job, n))).items()}
        out = out.withColumns(made)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in jobs], *[F.col(name(job, "out")).alias(job) for job in jobs])
