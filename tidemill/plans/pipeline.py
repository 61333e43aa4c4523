"""The whole run: normalise, deduplicate, validate, and the tables that come out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tidemill.operators.dedupe import deduplicate
from tidemill.operators.normalize import normalize
from tidemill.operators.outputs import changes_table, clean_table, rejects_table
from tidemill.operators.summary import Summary, summarise
from tidemill.operators.validate import validate
from tidemill.profile import Profile
from tidemill.sources.feed import Feed


@dataclass(frozen=True)
class Run:
    """judged: every row with values, changes, issues and role; the tables read it, lazily."""

    judged: DataFrame
    clean: DataFrame
    rejects: DataFrame
    changes: DataFrame
    feed: Feed
    profile: Profile

    def summary(self, source: str) -> Summary:
        return summarise(self.judged, source, self.profile.name, len(self.feed.mapped), self.feed.unmapped)


def judge(feed: Feed, profile: Profile, image_base: str = "", backfill: bool = True) -> DataFrame:
    return validate(deduplicate(normalize(feed.rows, profile, image_base), backfill), profile)


def run(feed: Feed, profile: Profile, image_base: str = "", backfill: bool = True, persist: bool = True) -> Run:
    judged = judge(feed, profile, image_base, backfill)
    if persist:  # five readers; lost blocks are computed again
        judged = judged.persist(StorageLevel.MEMORY_AND_DISK)
    return Run(judged, clean_table(judged, feed.unmapped), rejects_table(judged, feed.headers), changes_table(judged), feed, profile)
