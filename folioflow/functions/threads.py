"""Threads: bracket markup to text, headers of scenes, depth and parents of comments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# The tags of the markup, its rendered forms and the header of a response.
TAG = re.compile(r"\[(/?)(clr[a-z0-9-]*|ruby|dice|spo|sub|youtube|calcn?|aa|hr|bld|itl|img)((?: [^\[\]]*)?)\]")
LONE = {"img": "image", "youtube": "video", "hr": None}
RULE = "────────"
RESPONSE = "──── #"
RESPONSE_HEADER = r"^\s*\d{1,5}\s*[：:].{0,80}?[：:]\s*\d{4}/\d{1,2}/\d{1,2}.{0,60}$"
SEGMENT_HEADER = r"^─{4} #\d{1,5} .{0,200}· \d{4}-\d{2}-\d{2} \d{2}:\d{2}$"


def _own_line(out: list[str], line: str) -> None:
    before = next((part for part in reversed(out) if part), "\n")
    out.append(f"{'' if before.endswith(chr(10)) else chr(10)}{line}\n")


def _close(out: list[str], name: str, attributes: str, start: int) -> None:
    """What an element's end changes in the text that has been written since its start."""
    if name == "ruby":
        out.append(f"({attributes})")
    elif name.startswith("calc"):
        out[start:] = [f"【{attributes}】"]
    elif name == "dice":
        inner, sides = "".join(out[start:]), attributes.split(" ")
        plain = len(sides) == 2 and all(re.fullmatch(r"-?\d+", s) for s in sides) and inner
        head = f"[dice {attributes}]" if attributes else "[dice]"
        out[start:] = [f"【{sides[0]}~{sides[1]}: {inner.strip()}】" if plain else f"{head}{inner}[/dice]"]


def markup_text(content: str | None, deepest: int = 98) -> str | None:
    """The text of bracket markup in one pass.

    Styles leave their content, ruby its reading behind it, dice and sums their results, rules
    and media have lines of their own. An end that does not match the innermost element, an
    unknown tag and one below ``deepest`` elements stay as text; open elements end with the
    text. Attributes hold no brackets. Null stays null.
    """
    if content is None:
        return None
    out, stack, at = [], [], 0
    for tag in TAG.finditer(content):
        out.append(content[at : tag.start()])
        at = tag.end()
        name, attributes = "clr" if tag[2].startswith("clr") else tag[2], " ".join(tag[3].split())
        if tag[1]:
            if stack and stack[-1][0] == name and not tag[3]:
                _close(out, *stack.pop())
            else:
                out.append(tag[0])
        elif name == "hr":
            _own_line(out, RULE)
        elif name in LONE and re.match(r"https?://", attributes):
            _own_line(out, f"[{LONE[name]}] {attributes.split(' ')[0]}")
        elif name in LONE or len(stack) >= deepest:
            out.append(tag[0])
        else:
            stack.append((name, attributes, len(out)))
    out.append(content[at:])
    while stack:
        _close(out, *stack.pop())
    return "".join(out)


@F.pandas_udf(StringType())
def thread_text(content: pd.Series) -> pd.Series:
    """Bracket markup as text; its nesting needs a stack, which SQL lacks. Texts without brackets pass through."""
    return content.map(lambda c: c if c is None or "[" not in c else markup_text(c))


def segment_texts(responses: DataFrame, keys: list[str], seq: str, user: str, at: str, content: str, attachment: str, zone: str = "Asia/Seoul") -> DataFrame:
    """(keys, text) of each segment: its responses in order, each below a header with its time in ``zone``.

    ``at`` is in UTC without a zone. A segment is a bounded run of a thread's responses, so its
    texts fit in a row. Null texts and users are empty; an attachment counts if it is a web address.
    """
    local = F.substring(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(at)).cast("string"), 1, 16)
    header = F.concat(F.lit(RESPONSE), F.col(seq).cast("string"), F.lit(" "), F.coalesce(user, F.lit("")), F.lit(" · "), local)
    body = F.regexp_replace(thread_text(F.coalesce(content, F.lit(""))), r"\n\z", "")
    image = F.when(F.regexp_like(F.col(attachment), F.lit("^https?://")), F.concat(F.lit("\n[image] "), attachment)).otherwise("")
    lines = responses.select(*keys, F.col(seq).alias("_seq"), F.concat(header, F.lit("\n"), body, image).alias("_text"))
    ordered = F.sort_array(F.collect_list(F.struct("_seq", "_text")))
    return lines.groupBy(*keys).agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["_text"]), "\n\n"), F.lit("\n")).alias("text"))


def is_scene_header(line: Column) -> Column:
    """Whether a line is the header of a response, in one of the two forms; null is no header."""
    text = F.regexp_replace(line, r"(?U)^\s+|\s+\z", "")
    return F.coalesce((F.length(text) <= 240) & (F.regexp_like(text, F.lit(RESPONSE_HEADER)) | F.regexp_like(text, F.lit(SEGMENT_HEADER))), F.lit(False))


def comment_depth(classes: Column, style: Column, marked: Column, indent: int = 15) -> Column:
    """The depth of a comment: the most that a class (depth-2, reply), a reply mark within it or a left margin says.

    A margin counts if it is a multiple of ``indent`` pixels. Nulls say nothing.
    """
    numbers = F.transform(F.regexp_extract_all(F.coalesce(classes, F.lit("")), F.lit(r"(?:depth|reply|level)[-_]?(\d{0,4})"), F.lit(1)), lambda n: F.coalesce(n.try_cast("int"), F.lit(1)))
    margin = F.regexp_extract(F.coalesce(style, F.lit("")), r"margin-left\s*:\s*(\d{1,6})px", 1).try_cast("int")
    return F.greatest(F.lit(0), F.array_max(numbers), F.when(F.coalesce(marked, F.lit(False)), 1), F.when(margin % indent == 0, (margin / indent).cast("int")))


@F.pandas_udf(ArrayType(IntegerType()))
def comment_parents(depths: pd.Series) -> pd.Series:
    """Positions (from 1) of the parents of a page's comments: the nearest one before of less depth; null for none."""

    def parents(page):
        if page is None:
            return None
        open_, found = [], []
        for position, depth in enumerate(page, 1):
            while open_ and open_[-1][0] >= depth:
                open_.pop()
            found.append(open_[-1][1] if open_ else None)
            open_.append((depth, position))
        return found

    return depths.map(parents)


def legacy_comments(comments: DataFrame, keys: list[str], ident: str, parent: str, content: str, empty: str) -> DataFrame:
    """Comments with position, their place from 1 by id within a post, and parent_position, that of the parent (null without one).

    A comment of white space only, or null, has the text ``empty``. Ids are unique within a post.
    """
    rows = comments.withColumns({
        "position": F.row_number().over(Window.partitionBy(*keys).orderBy(ident)),
        content: F.when(F.trim(F.regexp_replace(content, r"\s+", " ")) != "", F.col(content)).otherwise(F.lit(empty)),
    })
    parents = rows.select(*keys, F.col(ident).alias(parent), F.col("position").alias("parent_position"))
    return rows.join(parents, [*keys, parent], "left")
