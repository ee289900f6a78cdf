from datetime import datetime, timezone

import pytest

from graphloom.operators.timestamps import ZoneTables, _column, _database, delivery_instants, parser_of, shape_mask, wall_to_instant, zone_files

import numpy as np
import pandas as pd


def one(text, zone="Etc/UTC", order="dmy"):
    out = _column(pd.Series([text]), pd.Series([zone]), pd.Series([order]), ZoneTables(*zone_files()))
    return None if pd.isna(out.iloc[0]) else int(out.iloc[0])


def us(*fields, micro=0):
    return int(datetime(*fields, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    "text,zone,order,expected",
    [
        ("2021-01-05T22:26:48.360953+01:00", None, None, us(2021, 1, 5, 21, 26, 48, micro=360953)),
        ("Thu, 7 Jan 2021 13:52:30 +0530 (IST)", None, None, us(2021, 1, 7, 8, 22, 30)),
        ("Mon Jan 11 14:19:40 PST 2021", None, None, us(2021, 1, 11, 22, 19, 40)),
        ("Sun Jan 10 15:30:38 2021 +0530", None, None, us(2021, 1, 10, 10, 0, 38)),
        ("2021-01-27 04:46:45 America/Los_Angeles", None, None, us(2021, 1, 27, 12, 46, 45)),
        ("05/04/21 5:31 AM", "Europe/London", "dmy", us(2021, 4, 5, 4, 31)),
        ("05/04/2021 5:31 PM", "America/New_York", "mdy", us(2021, 5, 4, 21, 31)),
        ("January 13, 2021 12:22:45 am", "Etc/UTC", "dmy", us(2021, 1, 13, 0, 22, 45)),
        ("14.01.2021 19:45:28", "Asia/Tokyo", "ymd", us(2021, 1, 14, 10, 45, 28)),
        ("20210110150200", "Asia/Kolkata", "dmy", us(2021, 1, 10, 9, 32)),
        ("20210107T021830Z", None, None, us(2021, 1, 7, 2, 18, 30)),
        ("1610331544593", None, None, 1610331544593000),
        ("1610175538", None, None, 1610175538000000),
        ("1611105350276279", None, None, 1611105350276279),
        ("2021-01-06T02:27:18,356", "Etc/UTC", "dmy", us(2021, 1, 6, 2, 27, 18, micro=356000)),
    ],
)
def test_formats(text, zone, order, expected):
    assert one(text, zone, order) == expected


@pytest.mark.parametrize(
    "text,zone",
    [
        ("", None), ("unknown", "Etc/UTC"), ("2021-01-21", "Etc/UTC"), ("2022-13-05 08:00:00 +0100", None), ("2023-02-30T10:11:12Z", None), ("Thu, 25:61", "Etc/UTC"),
        ("31/31/2022 10:00", "Etc/UTC"), ("0000-00-00 00:00:00", "Etc/UTC"), ("20210126", "Etc/UTC"), ("2021-03-14 02:54:27", "America/New_York"), ("2023-11-05T01:52:23", "America/New_York"),
        ("2021-01-05 10:00:00", None), ("2021-01-05 10:00:00 Nowhere/Town", None), ("2021-01-05 13:00 PM", "Etc/UTC"), ("x" * 5000, "Etc/UTC"), ("Fri, 7 Jan 2021 13:52:30 +0530", None),
    ],
)
def test_no_instant(text, zone):
    assert one(text, zone) is None


def test_mask_is_parsed_once():
    assert shape_mask("Mon Jan 11 2021") == "a a 99 9999"
    assert parser_of(shape_mask("2021-01-05 10:00:00")) is parser_of(shape_mask("1999-12-31 23:59:59"))


@pytest.mark.parametrize("zone", ["Europe/Berlin", "Europe/Dublin", "Australia/Sydney", "America/Sao_Paulo", "Africa/Casablanca", "Asia/Kathmandu"])
def test_transitions_agree_with_the_database(zone):
    import zoneinfo

    # the same files: the system's own may be of another version
    with open(f"{_database()[1][0]}/{zone}", "rb") as f:
        own = zoneinfo.ZoneInfo.from_file(f)
    table = ZoneTables(*zone_files()).get(zone)
    for year in (1900, 1945, 1960, 1987, 2021, 2060, 2437, 9990):
        for month in (1, 7):
            wall = np.array([us(year, month, 1, 12)], "int64")
            instant, settled = wall_to_instant(wall, *table)
            assert settled[0] and instant[0] == int(datetime(year, month, 1, 12, tzinfo=own).timestamp()) * 1_000_000, year


def test_unknown_zone():
    assert ZoneTables(*zone_files()).get("No/Where") is None


def test_long_texts_and_far_years():
    assert one("Thu, 7 Jan 2021 13:52:30 +0200 (" + "a long remark on the zone " * 6 + ")") == us(2021, 1, 7, 11, 52, 30)
    assert one("1960-01-15 12:00:00", "Europe/London") == us(1960, 1, 15, 12)
    assert one("2060-07-15 12:00:00", "Europe/London") == us(2060, 7, 15, 11)
    assert one("2300-07-15 12:00:00.123457", "Etc/UTC") == us(2300, 7, 15, 12, micro=123457)


def test_table(spark):
    mail = spark.createDataFrame([(1, 1, "2021-01-05 10:00:00", "x"), (2, None, "2021-01-05 10:00:00", "x"), (3, 9, "2021-01-05T10:00:00Z", None), (4, 1, None, "x")], "delivery_id bigint, site_id int, date string, zone_name string")
    sites = spark.createDataFrame([(1, "Asia/Tokyo", "ymd"), (1, "Asia/Tokyo", "ymd")], "site_id int, zone_name string, date_order string")
    got = {r[0]: r[1] for r in delivery_instants(mail, sites).collect()}
    assert got == {1: us(2021, 1, 5, 1), 3: us(2021, 1, 5, 10)}
    assert delivery_instants(mail.limit(0), sites.limit(0)).count() == 0
