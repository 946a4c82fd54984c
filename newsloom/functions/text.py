"""Text functions: cleaning, lead sentence, keyword scoring, headlines, URLs, bylines. All Catalyst expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv

SPACE = fv.SPACE_CLASS


# Literals of which a match needs one: a byte search spares most texts the regular expression.
NEEDLES = {
    r"\([^)]*\)": ["("],
    r"\[[^\]]*\]": ["["],
    r"[◇【】…]": ["◇", "【", "】", "…"],
    r"<[^>]*>": ["<"],
    r"&[a-zA-Z0-9#]+;": ["&"],
    fv.NOISE_PATTERNS[1][0]: ["기자"],
    fv.WIRE_PATTERNS[0][0]: ["기자"],
    fv.EMAIL_PATTERN: ["@"],
}


def replace_all(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Apply patterns in order."""

    def apply(c: Column, rule: tuple[str, str]) -> Column:
        pattern, replacement = rule
        needles = NEEDLES.get(pattern)
        if needles is None:
            return F.regexp_replace(c, pattern, replacement)

        def guarded(t: Column) -> Column:
            possible = reduce(lambda a, b: a | b, [F.contains(t, F.lit(n)) for n in needles])
            return F.when(possible, F.regexp_replace(t, pattern, replacement)).otherwise(t)

        return let(c, guarded)

    return reduce(apply, patterns, text)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_strip(text: Column) -> Column:
    """Strip every Unicode space on both ends (``trim`` knows the plain blank only)."""
    return F.btrim(text, F.lit(fv.SPACE_CHARS))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_blank(text: Column) -> Column:
    """Null or empty, the way a truth test sees it."""
    return F.coalesce(text, F.lit("")) == ""


# --- cleaning -------------------------------------------------------------------------------

def clean_noise(text: Column) -> Column:
    return py_strip(replace_all(F.coalesce(text, F.lit("")), fv.NOISE_PATTERNS))


def clean_title_noise(title: Column) -> Column:
    return py_strip(replace_all(clean_noise(title), fv.TITLE_NOISE_PATTERNS))


def clean_wire(text: Column) -> Column:
    """Remove wire-agency boilerplate: reporter, e-mail, agency tags, copyright tail."""
    return py_strip(replace_all(F.coalesce(text, F.lit("")), fv.WIRE_PATTERNS))


def drop_reporter_tail(text: Column, patterns: Sequence[str] = tuple(fv.REPORTER_TAIL_PATTERNS)) -> Column:
    return replace_all(text, [(p, "") for p in patterns])


def strip_markup(text: Column) -> Column:
    """Drop tags from text whose entities are decoded already; line breaks become blanks."""
    return py_strip(replace_all(F.coalesce(text, F.lit("")), fv.MARKUP_PATTERNS))


def lead_sentence(content: Column) -> Column:
    """Text before the first full stop, with the stop put back; else the first 100 characters."""
    first = py_strip(F.substring_index(content, ".", 1))
    fallback = F.substring(py_strip(content), 1, fv.LEAD_FALLBACK_CHARS)
    return F.coalesce(F.concat(blank_to_null(first), F.lit(".")), fallback, F.lit(""))


def embedding_input(lead: Column, title: Column) -> Column:
    """The lead as it stands, or the title when the lead is blank."""
    return F.when(py_strip(F.coalesce(lead, F.lit(""))) != "", lead).otherwise(F.coalesce(title, F.lit("")))


def truncate(text: Column, rule: tuple[int, int, str]) -> Column:
    longest, kept, tail = rule
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, kept), F.lit(tail))).otherwise(text)


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit("\"'"))


def report_text(text: Column) -> Column:
    """Report variant: double quotes first, then single quotes; null reads as empty."""
    return F.btrim(F.btrim(F.coalesce(text, F.lit("")), F.lit('"')), F.lit("'"))


# --- keyword classification -----------------------------------------------------------------

def count_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in the text; each counts once."""
    hits = [F.contains(text, F.lit(k)).cast("int") for k in keywords]
    return reduce(lambda a, b: a + b, hits) if hits else F.lit(0)


def classify_by_keywords(
    title: Column,
    lead: Column,
    rules: Mapping[str, Sequence[str]] = fv.CATEGORY_KEYWORDS,
    other: str = fv.OTHER_CATEGORY,
) -> Column:
    """``struct(score, category)``: best weighted substring score; the earlier category wins a tie.

    The fallback category takes part as one more candidate that scores exactly the threshold and
    sorts last, so that any category reaching the threshold beats it.
    """

    def best(low: Column) -> Column:
        candidates = [
            F.struct(
                (
                    F.lit(fv.TITLE_WEIGHT) * count_keywords(low["title"], words)
                    + F.lit(fv.LEAD_WEIGHT) * count_keywords(low["lead"], words)
                ).alias("score"),
                F.lit(-position).alias("precedence"),
                F.lit(name).alias("category"),
            )
            for position, (name, words) in enumerate(rules.items())
            if words
        ]
        fallback = F.struct(
            F.lit(fv.SCORE_THRESHOLD).alias("score"),
            F.lit(-len(rules) - 1).alias("precedence"),
            F.lit(other).alias("category"),
        )
        return F.array_max(F.array(*candidates, fallback))

    return let(F.struct(F.lower(title).alias("title"), F.lower(lead).alias("lead")), best)


def classify_word(word: Column) -> Column:
    """First class whose patterns match the word: person, position, event, reaction, else null."""
    branches = [(name, "|".join(patterns)) for name, patterns in fv.WORD_CLASSES.items()]
    return F.coalesce(*[F.when(word.rlike(pattern), F.lit(name)) for name, pattern in branches])


# --- headlines ------------------------------------------------------------------------------

def load_rules(name: str) -> list[dict]:
    """Rules that are data rather than code (they name people)."""
    return json.loads(resources.files("newsloom.data").joinpath(f"{name}.json").read_text("utf-8"))["rules"]


def single_title_headline(title: Column, rules: Sequence[Mapping] | None = None) -> Column:
    """Headline of a one-article group: canned rule, else the shortened title."""
    rules = load_rules("headline_rules") if rules is None else rules
    bare = py_strip(
        replace_all(
            F.coalesce(title, F.lit("")),
            [(r'(?d)".*?"', ""), (r"\([^)]*\)", ""), (SPACE + "+", " ")],
        )
    )

    def headline(bare: Column) -> Column:
        def all_words(words: Sequence[str]) -> Column:
            return reduce(lambda a, b: a & b, [F.contains(bare, F.lit(w)) for w in words])

        canned = [
            F.when(reduce(lambda a, b: a | b, [all_words(words) for words in rule["any_of"]]), F.lit(rule["headline"]))
            for rule in rules
        ]
        return F.coalesce(*canned, blank_to_null(truncate(bare, fv.SHORT_TITLE)), F.lit(fv.DEFAULT_HEADLINE))

    return let(bare, headline)


def group_headline(top_words: Column) -> Column:
    """Headline of a many-article group from its (at most two) most frequent words."""
    first, second = F.get(top_words, F.lit(0)), F.get(top_words, F.lit(1))
    headline = (
        F.when(second.isNotNull(), F.concat_ws(" ", first, second))
        .when(first.isNotNull(), F.concat_ws(" ", first, F.lit(fv.ONE_WORD_SUFFIX)))
        .otherwise(F.lit(fv.DEFAULT_GROUP_HEADLINE))
    )
    return truncate(headline, fv.SHORT_TITLE)


def template_title(person: Column, event: Column, reaction: Column) -> Column:
    """``person event…reaction`` with defaults for the last two."""
    title = F.concat(
        F.concat_ws(" ", blank_to_null(person), F.coalesce(event, F.lit(fv.DEFAULT_EVENT))),
        F.lit("…"),
        F.coalesce(reaction, F.lit(fv.DEFAULT_REACTION)),
    )
    return truncate(title, fv.ISSUE_TITLE)


# --- model answers --------------------------------------------------------------------------

EVENTS_DDL = "struct<events:array<struct<event_id:string,title:string,keywords:array<string>,description:string>>>"


def fenced_json(answer: Column) -> Column:
    """The JSON part of a model answer: inside a json fence, else inside a plain fence, else all of it."""
    json_fence = F.regexp_extract(answer, r"(?s)```json(.*?)(?:```|$)", 1)
    plain_fence = F.regexp_extract(answer, r"(?s)```(.*)```", 1)
    return py_strip(
        F.when(F.contains(answer, F.lit("```json")), json_fence)
        .when(F.contains(answer, F.lit("```")), plain_fence)
        .otherwise(answer)
    )


def parse_events(answer: Column) -> Column:
    """Event list of a model answer; null when it does not parse."""
    return F.from_json(fenced_json(answer), EVENTS_DDL)["events"]


# --- URLs, bylines, images ------------------------------------------------------------------

def absolute_url(href: Column, base: Column, force_https: bool = False) -> Column:
    url = F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(base, href)).otherwise(
        F.concat(base, F.lit("/"), href)
    )
    return F.regexp_replace(url, "^http://", "https://") if force_https else url


ARTICLE_ID_PATTERNS = {  # Fixed values: where each site keeps the article number in its URLs.
    "sisain": r"/(\d+)/?$",
    "hankyung": r"/article/(\d+)",
    "pressian": r"/pages/articles/(\d+)",
}


def article_id(url: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(url, pattern, 1))


def byline_author(text: Column) -> Column:
    """Author name without the trailing word for "reporter"."""
    return F.when(text.endswith("기자"), py_strip(F.regexp_replace(text, "기자$", ""))).otherwise(text)


def byline_email(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, f"({fv.EMAIL_PATTERN})", 1))


def mailto_address(href: Column) -> Column:
    return blank_to_null(F.regexp_extract(href, r'mailto:([^"]+)', 1))


def background_image(style: Column) -> Column:
    return blank_to_null(F.regexp_extract(style, r"background-image:\s*url\(['\"]?([^'\"]+)['\"]?\)", 1))


def real_image(src: Column) -> Column:
    """Null for the one-pixel placeholder."""
    return F.when(~F.contains(src, F.lit("1X1.png")), src)


def first_filled(*texts: Column) -> Column:
    """First of several texts that is not blank, stripped."""
    return F.coalesce(*[blank_to_null(py_strip(t)) for t in texts])


# --- paragraphs -----------------------------------------------------------------------------

def split_tail_byline(paragraphs: Column, is_byline) -> Column:
    """``struct(paragraphs, byline)``: the last paragraph moves to ``byline`` when it looks like one."""
    last = F.try_element_at(paragraphs, F.lit(-1))
    found = F.coalesce(is_byline(last), F.lit(False))
    return F.struct(
        F.when(found, F.slice(paragraphs, F.lit(1), F.size(paragraphs) - 1)).otherwise(paragraphs).alias("paragraphs"),
        F.when(found, last).alias("byline"),
    )


def keep_paragraphs(paragraphs: Column, longer_than: int, drop: Sequence[str] = ()) -> Column:
    """Paragraphs longer than a floor that match none of the drop patterns."""

    def wanted(p: Column) -> Column:
        keep = F.length(p) > longer_than
        return keep & ~p.rlike("|".join(f"(?:{d})" for d in drop)) if drop else keep

    return F.filter(paragraphs, wanted)


def drop_contained(texts: Column) -> Column:
    """Keep a text only when it is not part of one already kept."""
    return F.aggregate(
        texts,
        F.array().cast("array<string>"),
        lambda kept, t: F.when(F.exists(kept, lambda k: F.contains(k, t)), kept).otherwise(F.array_append(kept, t)),
    )


def order_by_number(paragraphs: Column, default: int = 999) -> Column:
    """Texts of ``array<struct<pos, number, text>>`` ordered by the number; not-a-number goes last."""
    keyed = F.transform(
        paragraphs,
        lambda p: F.struct(
            F.coalesce(p["number"].try_cast("int"), F.lit(default)).alias("number"), p["pos"], p["text"]
        ),
    )
    return F.transform(F.array_sort(keyed), lambda p: p["text"])
