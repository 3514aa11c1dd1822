"""Text, date, title and markup functions on written cases, the streams on small files, and folds against plain forms."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from folioflow.functions import bodies, dates, hangul, markup, text, titles
from folioflow.operators import merge, queue, reading, release, search, works
from folioflow.sources import store
from folioflow.streaming import jobs


def _column(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_source_dates(spark):
    captured = F.lit("2024-03-01 03:00:00").cast("timestamp")  # noon in Korea
    cases = {
        "2023-05-06 07:08": "2023-05-05 22:08:00", "2023.05.06": "2023-05-05 15:00:00", "23/05/06 07:08": "2023-05-05 22:08:00", "2023-05-06T07:08:09Z": "2023-05-06 07:08:09",
        "3분 전": "2024-03-01 02:57:00", "2시간전": "2024-03-01 01:00:00", "어제": "2024-02-29 03:00:00", "11:30": "2024-03-01 02:30:00", "23:30": "2024-02-29 14:30:00",
        "02-29 10:00": "2024-02-29 01:00:00", "12.31": "2023-12-30 15:00:00", "soon": None, "": None, None: None,
    }
    got = _column(spark, list(cases), F.date_format(dates.source_time(F.col("v"), captured), "yyyy-MM-dd HH:mm:ss"))
    assert got == list(cases.values())


def test_leap_day_goes_back_to_the_last_leap_year(spark):
    captured = F.lit("2023-03-01 03:00:00").cast("timestamp")
    assert _column(spark, ["02-29"], F.date_format(dates.source_time(F.col("v"), captured), "yyyy-MM-dd")) == ["2020-02-28"]


def test_titles(spark):
    values = ["[번역] [AA] 용사 이야기 제3화", "용사 이야기 4-6화", "(번역) Hero Story ep. 12 [완결]", "Hero #7", "Hero (8)", "Hero 9", "용사 프롤로그", "용사 6-4화", "용사", "ＨＥＲＯ １０화", "용사 2기 제3권 4화", "용사 외전 2화", "용사 5화: 귀환", "용사 - 서장", "용사 [3)", "용사 에필로그 (수정)"]
    got = _column(spark, values, titles.parse(titles.folded(F.col("v"))))
    assert [(r["base"], r["class"], None if r["start"] is None else float(r["start"]), None if r["end"] is None else float(r["end"]), r["reason"]) for r in got] == [
        ("용사 이야기", 1, 3, 3, None), ("용사 이야기", 1, 4, 6, None), ("(번역) hero story", 1, 12, 12, None), ("hero", 1, 7, 7, None), ("hero", 1, 8, 8, None), ("hero 9", None, None, None, "no_episode"),
        ("용사", 0, 0, 0, None), ("용사 6-4화", None, None, None, "reversed_range"), ("용사", None, None, None, "no_episode"), ("hero", 1, 10, 10, None), ("용사", 1, 4, 4, None), ("용사", 2, 2, 2, None),
        ("용사", 1, 5, 5, None), ("용사", 0, 0, 0, None), ("용사 [3)", None, None, None, "mismatched_bracket"), ("용사", 3, 0, 0, None),
    ]
    assert (got[10]["season"], got[10]["volume"], got[12]["subtitle"], got[15]["status"], got[1]["label"]) == (2, 3, "귀환", "수정", "4-6화")
    assert _column(spark, ["용사 이야기 제3화", "Hero EP. 3", "Plain"], titles.display_title(F.col("v"), titles.parse(titles.folded(F.col("v")))["label"])) == ["용사 이야기", "Hero", "Plain"]
    assert got[2]["status"] == "완결"
    assert _column(spark, ["2부 13화", "Part 4", "끝", None], titles.episode_number(F.col("v"))) == [13, None, None, None]
    assert _column(spark, ["", "a", "foobar"], titles.fnv1a(F.col("v"))) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    assert _column(spark, ["😀", "a"], titles.fnv1a(F.col("v"))) == [3409036472, 0xE40C292C]  # over UTF-16 units
    assert _column(spark, ["a"], titles.hue(F.col("v"))) == [0xE40C292C % 10]
    assert _column(spark, ["Straße!", None], titles.key(F.col("v"))) == ["strasse", None]


def test_hangul(spark):
    assert _column(spark, ["용사 A", "까치", ""], hangul.initials(F.col("v"))) == ["ㅇㅅ A", "ㄲㅊ", ""]
    assert _column(spark, ["각하"], hangul.jamo(F.col("v"))) == ["ㄱㅏㄱㅎㅏ"]
    assert _column(spark, ["까치", "apple", "カード", "漢字", "7", "ㅆ", "ｂｏｏｋ", "㐂"], hangul.group_key(F.col("v"))) == ["ㄱ", "A", "kana", "han", "#", "ㅅ", "B", "han"]
    assert _column(spark, ["용사전", "새 용사전", "운수", "욤사"], hangul.suggestion_rank(F.col("v"), "용사")) == [1, 2, None, 4]
    assert _column(spark, ["용사전"], hangul.suggestion_rank(F.col("v"), "ㅇㅅ")) == [3]


def test_markup(spark):
    html = "<html><title> A &amp; B </title><style>x{}</style><script>1<2</script><p>one<b>two &lt;</b><p>three</html>"
    assert _column(spark, [html, "", None, "<p>open"], markup.html_text(F.col("v"))) == ["A & B\none\ntwo <\nthree", "", None, "open"]
    assert _column(spark, [html, "<p>"], markup.truncated(F.col("v"))) == [False, True]
    base = F.lit("http://h.org/a/b?c")
    assert _column(spark, ["/x", "//k/y", "z", "https://q/"], markup.resolved(base, F.col("v"))) == ["http://h.org/x", "http://k/y", "http://h.org/a/z", "https://q/"]


def test_chapter_states_and_dead_codes(spark):
    rows = spark.createDataFrame([("complete", "held"), ("held", "discovered"), ("waiting", "unknown"), ("discovered", "complete"), (None, "unknown"), ("held", None)], "o string, n string")
    assert [r[0] for r in rows.select(merge.chapter_status(F.col("o"), F.col("n"))).collect()] == ["complete", "held", "waiting", "complete", "unknown", "held"]
    rows = spark.createDataFrame([(4, "parse"), (5, "parse"), (23, "net"), (24, "net"), (99, None)], "a int, c string")
    state = queue.failed_state(F.col("a"), F.col("c"), ["parse"], ["net"])
    assert [tuple(r) for r in rows.select(state, queue.retry_delay(F.col("a"))).collect()] == [("retry", 960), ("dead", 1920), ("retry", 21600), ("dead", 21600), ("retry", 21600)]


def test_expired_leases_are_claimed_again(spark):
    rows = spark.createDataFrame([(1, 1, "running", 0, 1, 0, 5), (1, 2, "running", 0, 1, 0, 50), (1, 3, "done", 9, 0, 0, None)], "board int, id int, state string, priority int, attempts int, next_attempt_at int, lease_expires_at int")
    assert [(r["id"], r["attempts"]) for r in queue.claim(rows, F.lit(10), 5).collect()] == [(1, 2)]


def test_page_around_against_a_plain_list(spark):
    values = [(i, None if i % 5 == 0 else i % 3) for i in range(23)]
    rows = spark.createDataFrame(values, "id int, v int")
    plain = [i for i, v in sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for around in range(23):
        at = plain.index(around)
        first = at // 4 * 4
        got = search.page_around(rows, "v", "id", 4, around).orderBy("position").collect()
        assert [(r["id"], r["position"]) for r in got] == [(plain[i], i) for i in range(first, min(first + 4, 23))]
        assert [(r["previous_id"], r["next_id"]) for r in got] == [(plain[i - 1] if i else None, plain[i + 1] if i < 22 else None) for i in range(first, min(first + 4, 23))]
    assert search.page_around(rows, "v", "id", 4, 99).count() == 0


def test_weighted_sample(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") < 100, 9.0).otherwise(1.0).alias("w"))
    picked = [[r["id"] for r in reading.weighted_sample(rows, "id", F.col("w"), 3, 50).collect()] for _ in range(2)]
    assert picked[0] == picked[1] and len(set(picked[0])) == 50
    assert sum(i < 100 for i in picked[0]) > 35


def test_intervals_do_not_depend_on_blocks(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 10, 12), (1, 5, 30), (1, 40, 41), (1, 50, 50), (2, 3, 1)], "k int, a int, b int")
    got = [sorted(tuple(r) for r in reading.interval_union(spans, ["k"], "a", "b", block).collect()) for block in (1, 7, 1000)]
    assert got == [[(1, 0, 30), (1, 40, 41)]] * 3


def test_links_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    assert dict(map(tuple, works.merge_links(links, "a", "b").collect())) == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_store_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, t string")
    store.write_version(rows, str(tmp_path), "posts", 1)
    back = store.read_version(spark, str(tmp_path), "posts", 1)
    assert store.manifest(rows, "posts").first() == store.manifest(back, "posts").first() != store.manifest(rows.distinct(), "posts").first()
    assert store.schema_faults(back, rows.schema) == [] and store.schema_faults(back.drop("t"), rows.schema) == ["missing t"]
    store.write_version(rows, str(tmp_path), "sharded", 1, shards=4, key="id")
    assert store.read_version(spark, str(tmp_path), "sharded", 1).count() == 3
    assert [r["t"] for r in store.append_new(rows, rows.filter("t IS NULL"), "id").collect()] == ["a"]


def test_streams(spark, tmp_path):
    source, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    at = lambda m: datetime(2024, 1, 1, 0, m, tzinfo=timezone.utc)
    first = spark.createDataFrame([(1, 1, at(0), "a"), (1, 2, at(1), "b"), (2, 3, at(2), "a")], "user long, id long, at timestamp, kind string")
    first.coalesce(1).write.parquet(str(source))
    events = lambda: spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(source))

    assert sorted((r["user"], r["inputs"]) for r in jobs.sessions(first, "user", "at", "5 minutes", "1 hour").collect()) == [(1, 2), (2, 1)]
    assert [r["n"] for r in jobs.daily_failures(first.filter("kind = 'a'"), "at", "kind", "1 hour").collect()] == [2]

    def read(number=999999):
        done = sorted(d for d in out.glob("batch=*") if int(d.name.split("=")[1]) < number)
        return spark.read.parquet(str(done[-1])) if done else None

    def write(frame, number):
        frame.write.mode("overwrite").parquet(f"{out}/batch={number:06d}")

    jobs.merge_latest(events(), ["user"], ["at", "id"], read, write, str(marks)).awaitTermination()
    assert sorted((r["user"], r["kind"]) for r in read().collect()) == [(1, "b"), (2, "a")]
    spark.createDataFrame([(1, 4, at(0), "old"), (2, 5, at(9), "new")], first.schema).coalesce(1).write.mode("append").parquet(str(source))
    jobs.merge_latest(events(), ["user"], ["at", "id"], read, write, str(marks)).awaitTermination()
    assert sorted((r["user"], r["kind"]) for r in read().collect()) == [(1, "b"), (2, "new")]

    unique = jobs.first_events(events(), ["kind"], "at", "1 hour").writeStream.format("memory").queryName("kinds").option("checkpointLocation", str(tmp_path / "marks2")).trigger(availableNow=True).start()
    unique.awaitTermination()
    assert sorted(r["kind"] for r in spark.table("kinds").collect()) == ["a", "b", "new", "old"]


def test_search_words_and_places_in_texts(spark):
    found = _column(spark, ["ＨＥＲＯ", "오크 킹", "he ro", None], text.contains_words(text.searchable(F.col("v")), "hero"))
    assert found == [True, False, True, False]
    assert _column(spark, ["오크 킹"], text.contains_words(text.searchable(F.col("v")), "오크킹")) == [True]
    docs = spark.createDataFrame([(1, "İİ the License x"), (2, "aXa" * 3), (3, None)], "id int, text string")
    assert [(r.id, r.start, r.exact, r.before) for r in search.keyword_in_context(docs, "license").collect()] == [(1, 7, "License", "İİ the ")]
    assert sorted((r.start, r.exact) for r in search.keyword_in_context(docs, "AX").collect()) == [(0, "aX"), (3, "aX"), (6, "aX")]


def test_fingerprints_tell_repeated_rows_apart(spark):
    prints = [release.fingerprint(spark.createDataFrame([(x,) for x in rows], "v int"), [], "v").collect() for rows in ([5, 5, 7, 7], [8, 8, 9, 9], [7, 5, 7, 5])]
    assert prints[0] != prints[1] and prints[0] == prints[2]


def test_bodies(spark):
    col = F.col("v")
    assert _column(spark, ["조회 1,234", "12", "1,23", "1 2", "", None], bodies.integer_token(col)) == [1234, 12, None, None, None, None]
    cases = {"a\r\nb\n": "a\nb\n", "a": None, " a\n": None, "# t\n# https://h/x\n\nprose\n": "prose\n", "# t\nprose\n": None, "a\0b\n": None, "\n": None, None: None}
    assert _column(spark, list(cases), bodies.canonical_body(col)) == list(cases.values())
    import hashlib
    import json

    rows = spark.createDataFrame([("제목 \"x\"", None, 3), ("t\n", "c", None)], "t string, c string, n int")
    expected = [hashlib.sha256(json.dumps([r.t, r.c, r.n], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for r in rows.collect()]
    assert [r[0] for r in rows.select(bodies.listing_fingerprint(F.col("t"), F.col("c"), F.col("n"))).collect()] == expected
    kind = "array<struct<kind:string,text:string>>"
    blocks = spark.createDataFrame([([("text", "a"), ("heading", " b ")],), ([("text", "a"), ("paid", "")],), ([("video", "x")],), ([],), (None,), ([("text", " ")],)], f"b {kind}")
    assert [tuple(r[0]) for r in blocks.select(bodies.blocks_text(F.col("b"))).collect()] == [("text", "a\n\nb"), ("waiting", None), ("review", None), ("invalid", None), ("invalid", None), ("invalid", None)]
    assert tuple(_column(spark, ["# T\n- category: c\n- author: me\n---\n- author: other"], bodies.header_fields(col))[0]) == ("T", "c", "me")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert _column(spark, ["120", "999999", "Mon, 01 Jan 2024 00:01:00 GMT", "Sun, 31 Dec 2023 00:01:00 GMT", "soon", None], bodies.retry_after(col, now)) == [120, 86400, 60, 0, None, None]
    assert _column(spark, ["ü?>", "a"], bodies.cursor_fields(bodies.cursor(col, F.lit(7)))) == [["ü?>", "7"], ["a", "7"]]
    assert _column(spark, ["2024-1-2T3:04:05Z", "2024.01.02", "soon"], bodies.date_label(col)) == ["2024.01.02 03:04", "2024.01.02", "soon"]
    assert _column(spark, ["http://h/a.PNG?x=1", "http://h/a", "https://h/b.mp4#t"], bodies.media_kind(col)) == ["image", "link", "video"]
    assert _column(spark, ["https://h/a/b.png?sig=1", "x"], bodies.path_key(col)) == ["a/b.png", None]
    assert _column(spark, ["[번역] (x) «hero»", "!!"], bodies.cover_initial(col)) == ["H", "!"]
    assert _column(spark, ["  a \n b  ", " "], bodies.clean_name(col)) == ["a b", None]
    assert _column(spark, ["please LOG IN", "text"], bodies.page_kind(col, {"login": "log in", "blocked": "denied"})) == ["login", "content"]
    comment = "array<struct<position:int,source_comment_id:string,parent_position:int,depth:int>>"
    cases = [([(1, "a", None, 0), (2, "b", 1, 1)], None), ([(1, "a", None, 0), (1, "b", None, 0)], "repeated_position"), ([(1, "a", None, 0), (2, "a", None, 0)], "repeated_id"), ([(1, None, 2, 1), (2, None, None, 0)], "parent"), ([(1, None, None, 1)], "depth"), ([(0, None, None, 0)], "position"), ([], None)]
    assert [r[0] for r in spark.createDataFrame([(c,) for c, _ in cases], f"c {comment}").select(bodies.comment_fault(F.col("c"))).collect()] == [fault for _, fault in cases]
    post = spark.createDataFrame([("stored", "b", 1, "https://h.org/b/1", "t", "x", 0), ("stored", "b", 1, "https://h.org/b/2", "t", "x", 0), ("stored", "b", 0, "u", "t", "x", 0), ("missing", "b", 1, "u", "t", "x", 0), ("stored", "b", 1, "https://h.org/b/1", " ", "x", 0), ("stored", "b", 1, "https://h.org/b/1", "t", "x", -1)], "outcome string, board_id string, external_post_id long, canonical_url string, title string, body_text string, views long")
    assert [r[0] for r in post.select(bodies.post_fault({c: F.col(c) for c in post.columns}, ("h.org",))).collect()] == [None, "canonical_url", "external_post_id", "outcome", "title", "views"]
