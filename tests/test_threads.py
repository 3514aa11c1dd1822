"""Markup, comments, sanitised HTML, wrapped bodies and stable codes on written cases."""

import random
import re

from pyspark.sql import functions as F

from folioflow.functions import bodies, codes, listings, sanitise, threads


def _column(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_markup(spark):
    cases = {
        "a [bld]b [clrred]c[/clrblue][/bld] d": "a b c d", "[ruby 읽기]漢字[/ruby]!": "漢字(읽기)!", "[dice 1 6] 4 [/dice]": "【1~6: 4】", "[dice 1 x]4[/dice]": "[dice 1 x]4[/dice]",
        "[calc 1 + 2]3[/calc]": "【1 + 2】", "a[hr]b": "a\n────────\nb", "[hr]b": "────────\nb", "x [img https://e.org/1.png] y": "x \n[image] https://e.org/1.png\n y", "[img none]": "[img none]",
        "[youtube https://e.org/v]": "[video] https://e.org/v\n", "[bld]open": "open", "[ruby a]open": "open(a)", "[itl]x[/bld]y[/itl]": "x[/bld]y", "[unknown]x[/unknown]": "[unknown]x[/unknown]", "[[bld]x[/bld]]": "[x]", "": "", None: None,
    }
    assert _column(spark, list(cases), threads.thread_text(F.col("v"))) == list(cases.values())
    deep = "[bld]" * 50_000 + "x"
    assert threads.markup_text(deep) == "[bld]" * (50_000 - 98) + "x"


def test_segments(spark):
    rows = spark.createDataFrame([(1, 2, "b", "2024-01-01 15:00:00", "[bld]two[/bld]\n", "https://e.org/x"), (1, 1, None, "2024-01-01 14:59:59", None, "x"), (2, 1, "c", "2024-06-01 00:00:00", "one", None)], "k int, seq int, u string, at string, c string, f string")
    found = threads.segment_texts(rows.withColumn("at", F.col("at").cast("timestamp_ntz")), ["k"], "seq", "u", "at", "c", "f").orderBy("k").collect()
    assert [r["text"] for r in found] == ["──── #1  · 2024-01-01 23:59\n\n\n──── #2 b · 2024-01-02 00:00\ntwo\n[image] https://e.org/x\n", "──── #1 c · 2024-06-01 09:00\none\n"]


def test_comments(spark):
    rows = spark.createDataFrame([("comment depth-2", None, False), ("reply", None, False), ("x", "color:red; margin-left: 45px", None), ("x", "margin-left:50px", True), (None, None, None)], "c string, s string, m boolean")
    assert [r[0] for r in rows.select(threads.comment_depth(F.col("c"), F.col("s"), F.col("m"))).collect()] == [2, 1, 3, 1, 0]
    rng = random.Random(3)
    pages = [[rng.randint(0, 4) for _ in range(n)] for n in (0, 1, 7, 30)]
    expected = [[max((j for j in range(1, i) if p[j - 1] < d), default=None) for i, d in enumerate(p, 1)] for p in pages]
    assert _column(spark, [*pages, None], threads.comment_parents(F.col("v")), "array<int>") == [*expected, None]


def test_clean_html(spark):
    cases = {
        '<p onclick="x()" class="AA_Text b">a<script>1<2</script>b': '<p class="AA_Text">ab</p>', '<a href=" java&#10;script:x" title="t">y</a>': '<a rel="noopener noreferrer" title="t">y</a>',
        '<a href="/p?q=1&amp;r">z': '<a href="/p?q=1&amp;r" rel="noopener noreferrer">z</a>', '<img src="data:x" alt="i"/><custom>t</custom>': '<img alt="i">t', "<b><i>x</b>y": "<b><i>x</i></b>y", "x</b>&lt;script&gt;": "x&lt;script&gt;",
        '<td style="color: red; position: fixed; margin: 1px; color: url(x)">': '<td style="color: red;margin: 1px"></td>', "<iframe><b>x</b></iframe>y<!-- c -->": "y", "": "", None: None,
    }
    got = _column(spark, list(cases), sanitise.clean_html(F.col("v")))
    assert got == list(cases.values())
    assert _column(spark, got, sanitise.clean_html(F.col("v"))) == got  # clean HTML stays as it is
    assert sanitise.clean("<b>" * 20_000) == "<b>" * 20_000 + "</b>" * 20_000


def test_bodies(spark):
    key = "20230607sac/0123456789abcdef.webp"
    cases = {
        f"# t\r\n- a: b\r\n\r\n---\r\nx\n[image] https://i.e.org/{key}?k=1\nsee https://i.e.org/{key}\n": f"x\n[image] media:{key}\nsee https://i.e.org/{key}\n", f"# t\n---\n[image] https://note.org/{key}": f"[image] https://note.org/{key}",
        "# t\nfree\n---\nx": None, "t\n---\nx": None, "# t\n- a": None, "# t\n---\n": "", "# t\n---\na\0": None, None: None,
    }
    assert _column(spark, list(cases), bodies.board_body(F.col("v"), ("e.org",))) == list(cases.values())
    novel = ["# t\n# https://e.org/1\n\n\nbody\r\nend\n", "# t\n #\nhttps://e.org/2\nbody", "# t\nbody", "body", "﻿# t\n# https://e.org/3 "]
    assert [tuple(r) for r in _column(spark, novel, bodies.novel_wrapper(F.col("v")))] == [("body\nend\n", "https://e.org/1"), ("body", "https://e.org/2"), ("# t\nbody", ""), ("body", ""), ("", "https://e.org/3")]
    board = ["# t\n- url: https://e.org/1\n- a: b\n---\n\nbody\n---\nx", "# t\n---\nbody", "t\n---\nx", "# t\n" + "\n" * 20 + "---\nx", "# t"]
    assert [tuple(r) for r in _column(spark, board, bodies.board_wrapper(F.col("v")))] == [("body\n---\nx", "https://e.org/1"), ("body", ""), ("t\n---\nx", ""), ("# t\n" + "\n" * 20 + "---\nx", ""), ("# t", "")]
    edge = ["# t\n" + "- a: b\n" * n + "---\nx" for n in (14, 15)]  # the rule is the sixteenth line, and the one behind it
    assert [r["text"] for r in _column(spark, edge, bodies.board_wrapper(F.col("v")))] == ["x", edge[1]]
    assert _column(spark, [1 << 30, 100 << 30, 1 << 40], bodies.archive_budget(F.col("v")), "long") == [2 << 30, 10 << 30, 20 << 30]
    assert _column(spark, ["x" * 1_000_000 + "\n"], bodies.board_body(F.col("v"), ("e.org",))) == [None]


def test_codes(spark):
    assert _column(spark, ['{"b": [1, {"d": 1, "c": "é"}], "a": null}', "3", "no", None], codes.stable_json(F.col("v"))) == ['{"a":null,"b":[1,{"c":"é","d":1}]}', "3", None, None]

    def draws(text, n):
        state = 0x811C9DC5
        for c in text:
            state = (state ^ ord(c)) * 0x01000193 % 2**32
        for _ in range(n):
            state = (state + 0x6D2B79F5) % 2**32
            v = (state ^ state >> 15) * (state | 1) % 2**32
            v = (v + (v ^ v >> 7) * (v | 61)) % 2**32 ^ v
            yield (v ^ v >> 14) / 2**32

    texts = ["", "2024-05-06#0", "용사😀"]
    for n in (1, 2, 9):
        assert _column(spark, texts, codes.seeded_number(F.col("v"), F.lit(n))) == [list(draws(t, n))[-1] for t in texts]


def test_scene_headers(spark):
    lines = ["\t12 : name : 2024/1/2 10:00", "──── #12 a◆b · 2026-10-07 20:35\r", "──── 12", "x" * 300, "", None]
    assert _column(spark, lines, threads.is_scene_header(F.col("v"))) == [True, True, False, False, False, False]
    assert re.match(threads.SEGMENT_HEADER, lines[1].strip())


def test_listings(spark):
    pages = ['[{"id": 1}]', '{"data": [{"id": 1, "authorName": "", "author": "a"}], "total": 4}', '{"results": [], "size": 0}', '{"items": [{"id": "1"}, {"id": 1}]}', '{"works": [{"title": "t"}]}', "no", None]
    got = _column(spark, pages, listings.catalogue_page(F.col("v")))
    assert [r["fault"] for r in got] == ["shape_unknown", None, "paging_invalid", "duplicate_id", "rows_rejected", "shape_unknown", "shape_unknown"]
    assert (got[1]["total"], got[1]["size"], tuple(got[1]["works"][0])) == (4, 20, ("1", "", "", "a"))
    details = [
        '{"id": 5, "title": "t", "author": "a", "chapters": [{"id": 1, "price": 3, "access": "FREE"}, {"id": "x"}, {"id": 2, "points": 3, "number": "007"}, {"id": 3, "status": "locked", "title": " e ", "kind": "side"}]}',
        '{"id": 5, "episodes": [], "episodeCount": 1}', '{"id": 5}', '{"id": "x", "episodes": []}', "[]", None,
    ]
    got = _column(spark, details, listings.work_detail(F.col("v")))
    assert [r["fault"] for r in got] == [None, "episodes_incomplete", "episodes_unknown", "id_invalid", "shape_unknown", "shape_unknown"]
    assert [(e["id"], e["access"], e["label"], e["toc_position"], e["kind"]) for e in got[0]["episodes"]] == [("1", "unknown", "", 0, None), ("2", "point", "7", 2, None), ("3", "point", "e", 3, "side")]
    fine = '{"id": 3, "title": "t", "username": "u", "createdAt": "2024-01-01T00:00:00+09:00", "updatedAt": "2024-01-01T00:00:00Z", "responseCount": 3, "ended": true, "secret": 1}'
    got = _column(spark, [fine, fine.replace('"ended": true', '"ended": 1'), '{"id": 3, "published": false}', fine.replace('"t"', '""'), "x", None], listings.thread_record(F.col("v")))
    assert [r["status"] for r in got] == ["fine", "invalid", "dropped", "invalid", "invalid", "invalid"]
    assert (got[0]["thread_id"], got[0]["ended"], got[0]["top"], str(got[0]["created_at"])) == (3, True, False, "2023-12-31 15:00:00") and "secret" not in got[0].asDict()
    reply = '{"seq": 0, "username": "", "content": "c", "attachment": "", "createdAt": "2024-01-01T00:00:00Z", "ip": "x"}'
    got = _column(spark, [reply, reply.replace("{", '{"threadId": 8, ', 1), reply.replace('"c"', "null"), None], listings.response_record(F.col("v"), F.lit(7)))
    assert [r["status"] for r in got] == ["fine", "invalid", "invalid", "invalid"] and (got[0]["seq"], got[0]["attachment"], got[0]["author_id"]) == (0, None, "")
