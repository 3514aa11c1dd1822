"""Titles, labels and names on written cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.functions import bodies, titles
from tests.test_functions import _column

EPISODES = {
    "이야기 1.5화": ("이야기", "1.5화", 0, 0, 1, "1.5", "1.5"),
    "이야기 10 ~ 12 회": ("이야기", "10 ~ 12 회", 0, 0, 1, "10", "12"),
    "이야기 2기 3화": ("이야기", "2기 3화", 2, 0, 1, "3", "3"),
    "이야기 - 제2부 제7화": ("이야기", "제2부 제7화", 0, 2, 1, "7", "7"),
    "story season 2": ("story season 2",) + (None,) * 6,
    "story vol.3 12 chapter": ("story vol.3", "12 chapter", 0, 0, 1, "12", "12"),
    "story 3 vol. 12 chapter": ("story", "3 vol. 12 chapter", 0, 3, 1, "12", "12"),
    "story (03)": ("story", "(03)", 0, 0, 1, "03", "03"),
    "story [4]": ("story", "[4]", 0, 0, 1, "4", "4"),
    "story # 4": ("story", "# 4", 0, 0, 1, "4", "4"),
    "story: episode 9.5": ("story", "episode 9.5", 0, 0, 1, "9.5", "9.5"),
    "story 4장: 5화: 끝": ("story", "4장", 0, 0, 1, "4", "4"),
    "특별편 2화": ("", "2화", 0, 0, 2, "2", "2"),
    "이야기특별편 2화": ("이야기특별편", "2화", 0, 0, 1, "2", "2"),
    "이야기 막간": ("이야기", "막간", 0, 0, 1, "0", "0"),
    "[aa][번역]  [소설] 이야기 epilogue": ("이야기", "epilogue", 0, 0, 3, "0", "0"),
    "[기타] 이야기 5편": ("[기타] 이야기", "5편", 0, 0, 1, "5", "5"),
    "12화": ("", "12화", 0, 0, 1, "12", "12"),
}


@pytest.mark.parametrize("title", EPISODES)
def test_episodes(title):
    base, label, season, volume, kind, first, last = EPISODES[title]
    assert titles.read_title(title)[:7] == (base, label, season, volume, kind, first, last)


def test_reasons_states_and_odd_titles():
    assert [titles.read_title(t)[9] for t in ("이야기 6-4화", "이야기 [3)", "이야기 (3]", "이야기", "", None, "이야기 )", "이야기 3)")] == ["reversed_range", "mismatched_bracket", "mismatched_bracket", "no_episode", "no_episode", "no_episode", "no_episode", "no_episode"]
    assert [titles.read_title(t)[7] for t in ("이야기 3화 完", "이야기 3화(완결)", "이야기 3화 [재업]", "이야기 (완) 3화")] == ["完", "완결", "재업", None]
    assert titles.read_title("이야기 5화:   귀환")[8] == "귀환"
    assert titles.read_title("이야기 5화:")[9] == "no_episode"


def test_large_numbers_and_nulls_in_columns(spark):
    got = _column(spark, ["이야기 " + "9" * 30 + "화", None, "이야기 99999999999기 3화"], titles.parse(F.col("v")))
    assert (got[0]["base"], got[0]["start"], got[1]["reason"], got[1]["base"], got[2]["season"]) == ("이야기", 0, "no_episode", None, 0)


def test_series_forms():
    cases = {"제목 - 12 -": "제목", "제목 <~3편~>": "제목", "제목 〈 4화.": "제목", "【a】[b】 제목 5부": "제목", "제목 12.)": "제목 12.)", "제목 3기 외전": "제목 3기 외전", "[open 제목 2": "[open 제목", "제목　７": "제목"}
    assert {t: titles.series_parts(t)[0] for t in cases} == cases
    assert titles.series_parts("【a】 [b】 제목 5부")[1] == "【a】 [b】"


def test_episode_numbers_and_gaps(spark):
    labels = ["2회차 리메이크-31화", "3화 2회차", "Chapter 12", "１２話", "7회", "3편", "5장", "4 화", "화", None]
    assert _column(spark, labels, titles.episode_number(F.col("v"))) == [31, 3, None, 12, 7, None, None, 4, None, None]
    gaps = spark.createDataFrame([(31, 34), (31, 32), (31, 1), (None, 3), (3, None)], "a long, b long").select(titles.episode_gap(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in gaps] == [2, 0, 0, 0, 0]


def test_initials_names_and_sizes(spark):
    initials = ["【단편】가나", "<중편> 다라", "★별", "[AA]", "", None, "«hero»", " (x) [y] e\u0301a", "👩‍👧 집", "[a"]
    assert _column(spark, initials, bodies.cover_initial(F.col("v"))) == ["가", "다", "★", "[", "?", "?", "H", "E\u0301", "👩‍👧", "A"]
    assert _column(spark, ["  a \n b  ", "가", "x" * 40, "😀" * 20, " ", None], bodies.clean_name(F.col("v"))) == ["a b", "가", "x" * 30, "😀" * 15, None, None]
    sizes = spark.createDataFrame([(n,) for n in (0, 999, 1023, 1024, 12_800, 1_047_552, 1 << 20, 5 << 30, -1, None)], "v long")
    assert [r[0] for r in sizes.select(bodies.size_label(F.col("v"))).collect()] == ["0B", "999B", "1,023B", "1KB", "13KB", "1,023KB", "1.0MB", "5120.0MB", "", ""]


def test_relative_times_and_durations(spark):
    now = datetime.datetime(2024, 3, 1, 12)
    ago = [datetime.timedelta(seconds=s) for s in (20, 31, 45 * 60, 61 * 60, 23 * 3600, 24 * 3600, 40 * 3600, -7200)]
    rows = spark.createDataFrame([(now - d,) for d in ago] + [(None,)], "v timestamp")
    got = [r[0] for r in rows.select(bodies.relative_time(F.col("v"), F.lit(now))).collect()]
    assert got == ["방금", "1분 전", "45분 전", "1시간 전", "23시간 전", "1일 전", "2일 전", "2시간 후", ""]
    spans = spark.createDataFrame([(n,) for n in (0, 29_999, 30_000, 3_600_000, 5_430_000)], "v long")
    assert [r[0] for r in spans.select(bodies.minutes_label(F.col("v"))).collect()] == ["0분", "0분", "1분", "1시간", "1시간 31분"]
