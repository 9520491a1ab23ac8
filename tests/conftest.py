import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SF_TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cases(spark):
    from stepfall import schemas
    from stepfall.sources.tables import records
    day = dt.date(2026, 6, 1)
    return records(spark, [(c, day, 28, 14, False, False, 8.0) for c in ("a", "b")],
                   schemas.CASES)


EVENT = ("instance_id string, session_id string, user_id string, event_ts timestamp_ntz, "
         "event_name string, canonical string, screen string, latency_ms int, "
         "is_crash boolean, payment_method string, os string")


@pytest.fixture(scope="session")
def make_events(spark):
    """Rows (session, user, 'day hh:mm', canonical, extras) to an events table of case a."""
    def build(rows):
        out = []
        for sid, uid, at, canonical, *more in rows:
            extra = more[0] if more else {}
            day, clock = at.split()
            hour, minute = map(int, clock.split(":"))
            ts = dt.datetime(2026, 6, 1) + dt.timedelta(days=int(day), hours=hour, minutes=minute)
            out.append((
                extra.get("case", "a"), sid, uid, ts, extra.get("name", canonical), canonical,
                extra.get("screen", "app"), extra.get("latency"), extra.get("crash", False),
                extra.get("pay"), extra.get("os", "X")))
        return spark.createDataFrame(out, EVENT)
    return build


USERS = ("instance_id string, user_id string, os string, device_type string, "
         "device_age_months int, geo string, channel string, is_returning boolean")


@pytest.fixture(scope="session")
def make_users(spark):
    def build(rows):
        full = []
        for uid, over in rows:
            base = dict(case="a", os="X", device_type="mid", age=10, geo="G", channel="paid",
                        ret=True)
            base.update(over)
            full.append((base["case"], uid, base["os"], base["device_type"], base["age"],
                         base["geo"], base["channel"], base["ret"]))
        return spark.createDataFrame(full, USERS)
    return build


def rows(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)
