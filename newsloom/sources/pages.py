"""Landed news pages: an Arrow step reports what is where, everything else is Spark expressions.

Site rules are data. They reach the expressions as one literal map from site to rule, so the plan does
not grow with the number of sites.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import dates, text
from newsloom.functions import fixed_values as fv
from newsloom.operators.tables import link_allowed, title_long_enough
from newsloom.operators.windows import keep_first
from newsloom.sources.page_reader import Place, SiteReader, read_page
from newsloom.sources.site_rules import NOTE_MARK, PLAIN_RULE, RICH_FIELDS, SITE_RULES

CAPTURES = "array<struct<scope:int,name:string,rank:int,text:string,attrs:map<string,string>,figure:int,tag:string>>"
ITEM_FIELDS = ["title", "link", "section", "description", "date", "year", "month_day", "image", "image_alt", "author",
               "subtitle", "style"]
RULE_DDL = (
    "struct<base_url:string,per_page:int,min_title:boolean,unique_id:boolean,https:boolean,longer_than:int,drop:string,"
    "fallback_longer_than:int,fallback_drop:string,whole_longer_than:int,whole_blocks:boolean,first:int,joiner:string,"
    "reporter_tail:boolean,drop_contained:boolean,order_by:boolean,byline:string,wire:boolean,squeeze:boolean,"
    "raw_text:boolean>"
)
NEVER = "(?!)"  # matches nothing
LD_SELECTOR = 'script[type="application/ld+json"]'


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages under the fixed schema; fetching is somebody else's job."""
    return spark.read.schema(schemas.schema("pages_raw")).parquet(path)


# --- rules ----------------------------------------------------------------------------------

def _place(name: str, where: str, **options) -> Place:
    selector, _, attribute = where.partition("@")
    return Place(name, selector, attribute or None, **options)


def _list_reader(rule: dict) -> SiteReader:
    items = rule.get("list", {"items": []})
    places = [_place(name, p) for name in ITEM_FIELDS for p in items.get(name, [])]
    return SiteReader(items["items"], places, [])


def _body_reader(rule: dict) -> SiteReader:
    body = rule["body"]
    places = [Place(n, s, join=body["join"], body=True) for n in ("paragraph", "fallback") for s in body[n]]
    places += [
        Place(name, s, join="\n" if name == "note" else "") for name, selectors in RICH_FIELDS.items() for s in selectors
    ]
    dated = rule["dates"] if "$datePublished" in rule["dates"] else [*rule["dates"], "$datePublished"]
    places += [
        Place("date_ld", LD_SELECTOR, join=None, in_scope=False) if p.startswith("$") else _place("date", p, in_scope=False)
        for p in dated
    ]
    places.append(Place("page_title", "title", in_scope=False))
    for name, where in rule.get("page_fields", {}).items():
        places += [_place(f"page_{name}", p, in_scope=False) for p in where]
    return SiteReader(body["containers"], places, body["exclude"], None if rule["keep"].get("whole_blocks") else body["join"])


def _rule_row(name: str, rule: dict) -> dict:
    keep, items = rule["keep"], rule.get("list", {})

    def any_of(patterns: list[str]) -> str:
        return "|".join(f"(?:{p})" for p in patterns) if patterns else NEVER

    return {
        "base_url": rule["base_url"],
        "per_page": items.get("per_page"),
        "min_title": items.get("min_title", False),
        "unique_id": items.get("unique_id", False),
        "https": name == "segye",
        "longer_than": keep["longer_than"],
        "drop": any_of(keep["drop"]),
        "fallback_longer_than": keep.get("fallback_longer_than", keep["longer_than"]),
        "fallback_drop": any_of(keep.get("fallback_drop", [])),
        "whole_longer_than": keep.get("whole_longer_than"),
        "whole_blocks": keep.get("whole_blocks", False),
        "first": keep.get("first"),
        "joiner": keep["joiner"],
        "reporter_tail": keep.get("reporter_tail", False),
        "drop_contained": keep.get("drop_contained", False),
        "order_by": "order_by" in keep,
        "byline": keep.get("byline", NEVER),
        "wire": keep.get("wire", False),
        "squeeze": keep.get("squeeze", False),
        "raw_text": rule["body"]["join"] is None,
    }


def with_rule(df: DataFrame, rules: Mapping[str, dict]) -> DataFrame:
    """Adds ``rule``, looked up in a literal map by the ``source`` column."""
    table = F.from_json(F.lit(json.dumps({n: _rule_row(n, r) for n, r in rules.items()})), f"map<string,{RULE_DDL}>")
    plain = F.from_json(F.lit(json.dumps(_rule_row("", PLAIN_RULE))), RULE_DDL)
    return df.withColumn("rule", F.coalesce(F.try_element_at(table, F.col("source")), plain))


def _rule(field: str) -> Column:
    return F.col(f"rule.{field}")


# --- captures -------------------------------------------------------------------------------

def with_captures(pages: DataFrame, kind: str, rules: Mapping[str, dict] = SITE_RULES) -> DataFrame:
    """Adds ``captures`` for list pages (``kind="list"``) or article pages (``kind="body"``); drops the page itself."""
    make = {"list": _list_reader, "body": _body_reader}[kind]
    readers = {name: make(rule) for name, rule in rules.items()}
    plain = make(PLAIN_RULE)
    arrow_type = pa.list_(
        pa.struct(
            [
                ("scope", pa.int32()),
                ("name", pa.string()),
                ("rank", pa.int32()),
                ("text", pa.string()),
                ("attrs", pa.map_(pa.string(), pa.string())),
                ("figure", pa.int32()),
                ("tag", pa.string()),
            ]
        )
    )

    @F.arrow_udf(CAPTURES)
    def capture(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for source, html in batches:
            pairs = zip(source.to_pylist(), html.to_pylist(), strict=True)
            yield pa.array([list(read_page(page, readers.get(site, plain))) for site, page in pairs], type=arrow_type)

    # Marked so that a later filter is not pushed below it as a second parse.
    return pages.withColumn("captures", capture.asNondeterministic()("source", "html")).drop("html")


# --- list pages -----------------------------------------------------------------------------

def list_items(pages: DataFrame, rules: Mapping[str, dict] = SITE_RULES) -> DataFrame:
    """``(page_id, source, pos, title, url, …)``: one row per listed article, in page order.

    A field takes its first filled place. Items are put together within their page, without a shuffle.
    """
    captured = with_rule(with_captures(pages.select("page_id", "source", "html"), "list", rules), rules)
    located = F.filter("captures", lambda c: (c["scope"] >= 0) & ~text.is_blank(text.py_strip(c["text"])))
    scopes = F.array_distinct(F.transform(F.filter("captures", lambda c: c["name"] == "scope"), lambda c: c["scope"]))
    scoped = captured.withColumn("captures", located).select("page_id", "source", "rule", "captures", F.explode(scopes).alias("pos"))

    def value(name: str) -> Column:
        hits = F.filter("captures", lambda c: (c["scope"] == F.col("pos")) & (c["name"] == name))
        best = F.array_min(F.transform(hits, lambda c, i: F.struct(c["rank"].alias("rank"), i.alias("i"), c["text"].alias("text"))))
        return text.py_strip(best["text"]).alias(name)

    items = scoped.select("page_id", "source", "rule", "pos", *[value(n) for n in ITEM_FIELDS])
    numbers = F.lit(None).cast("string")
    for name, pattern in text.ARTICLE_ID_PATTERNS.items():
        numbers = F.when(F.col("source") == name, text.article_id(F.col("link"), pattern)).otherwise(numbers)
    url = text.absolute_url(F.col("link"), _rule("base_url"))
    return items.where(F.col("title").isNotNull() & F.col("link").isNotNull()).select(
        "page_id",
        "source",
        "pos",
        F.when(_rule("unique_id"), text.squeeze(F.col("title"))).otherwise(F.col("title")).alias("title"),
        F.when(_rule("https"), F.regexp_replace(url, "^http://", "https://")).otherwise(url).alias("url"),
        numbers.alias("article_id"),
        F.col("link").alias("href"),
        "section",
        "description",
        text.blank_to_null(
            F.coalesce("date", F.concat_ws("-", "year", F.regexp_replace("month_day", r"\.", "-")))
        ).alias("date_text"),
        text.byline_author(F.col("author")).alias("author"),
        "subtitle",
        F.coalesce(text.real_image(F.col("image")), text.background_image(F.col("style"))).alias("image_url"),
        "image_alt",
    )


def accepted_items(items: DataFrame, rules: Mapping[str, dict] = SITE_RULES) -> DataFrame:
    """List items after link, title-length, uniqueness and per-page rules."""
    ruled = with_rule(items, rules).where(link_allowed(F.col("source"), F.col("href"), F.col("section")))
    kept = ruled.where(~_rule("min_title") | title_long_enough(F.col("title")))
    identity = F.when(_rule("unique_id"), F.coalesce("article_id", "url")).otherwise(F.col("pos").cast("string"))
    unique = keep_first(kept.withColumn("__identity", identity), ["page_id", "source", "__identity"], [F.asc("pos")])
    return first_per_page(unique.drop("__identity"), _rule("per_page")).drop("rule")


def first_per_page(items: DataFrame, cap: Column) -> DataFrame:
    """The first ``cap`` items of every page; a page is one document, so its items fit one task."""
    page = Window.partitionBy("page_id", "source").orderBy("pos")
    return items.withColumn("item_rank", F.row_number().over(page)).where(cap.isNull() | (F.col("item_rank") <= cap))


# --- article pages --------------------------------------------------------------------------

def _named(name: str) -> Column:
    return F.filter("captures", lambda c: c["name"] == name)


def _inside(name: str) -> Column:
    return F.filter("captures", lambda c: (c["name"] == name) & (c["scope"] == F.col("body")))


def _texts(captures: Column) -> Column:
    return F.transform(captures, lambda c: c["text"])


def _attribute(capture: Column, name: str) -> Column:
    return F.try_element_at(capture["attrs"], F.lit(name))


def _date_texts() -> Column:
    """Candidate date texts in order of trust; of equal trust, in page order."""

    def value(c: Column, i: Column) -> Column:
        linked = F.coalesce(F.get_json_object(c["text"], "$.datePublished"), F.get_json_object(c["text"], "$.dateModified"))
        return F.struct(
            c["rank"].alias("rank"), i.alias("i"), F.when(c["name"] == "date_ld", linked).otherwise(c["text"]).alias("text")
        )

    dated = F.filter("captures", lambda c: c["name"].isin("date", "date_ld"))
    ordered = F.transform(F.array_sort(F.transform(dated, value)), lambda d: d["text"])
    return F.filter(ordered, lambda t: ~text.is_blank(t))


def first_by_href(links: Column) -> Column:
    """Links without those whose target occurred before."""
    return F.filter(
        links,
        lambda link, i: ~F.exists(F.slice(links, F.lit(1), i), lambda earlier: earlier["href"] == link["href"]),
    )


def article_candidates(pages: DataFrame, rules: Mapping[str, dict] = SITE_RULES) -> DataFrame:
    """Adds body candidates of the most trusted container, date texts, headings, images, links, byline."""
    kept = [c for c in pages.columns if c != "html"]
    captured = with_rule(with_captures(pages, "body", rules), rules)
    # The most trusted kind of container; the first of its kind on the page.
    best = F.array_min(F.transform(_named("scope"), lambda c: F.struct(c["rank"].alias("r"), c["scope"].alias("s"))))
    located = captured.withColumn("body", best["s"])
    plain = F.when(_rule("raw_text"), F.transform(_texts(_inside("paragraph")), text.strip_markup)).otherwise(
        _texts(_inside("paragraph"))
    )
    numbered = F.transform(
        _inside("paragraph"),
        lambda c, i: F.struct(i.alias("pos"), _attribute(c, "data-divno").alias("number"), c["text"].alias("text")),
    )
    staged = located.select(
        *kept,
        "rule",
        F.col("body").isNotNull().alias("container_found"),
        F.when(_rule("order_by"), text.order_by_number(numbered)).otherwise(plain).alias("paragraphs"),
        _texts(_inside("fallback")).alias("fallbacks"),
        F.coalesce(F.get(_texts(_inside("scope")), F.lit(0)), F.lit("")).alias("whole_text"),
        _date_texts().alias("date_texts"),
        F.get(_texts(_named("page_title")), F.lit(0)).alias("page_title"),
        F.filter(_texts(_inside("heading")), lambda t: t != "").alias("headings"),
        _inside("image").alias("__images"),
        _inside("figure").alias("__figures"),
        _inside("caption").alias("__captions"),
        F.filter(
            F.transform(
                _inside("heading"),
                lambda c: F.struct(F.substring(c["tag"], 2, 1).cast("int").alias("level"), c["text"].alias("text")),
            ),
            lambda h: h["text"] != "",
        ).alias("outline"),
        F.transform(
            _inside("link"),
            lambda c: F.struct(
                c["text"].alias("text"),
                _attribute(c, "href").alias("href"),
                text.absolute_url(_attribute(c, "href"), _rule("base_url")).alias("url"),
            ),
        ).alias("__links"),
        F.get(F.filter(_texts(_inside("note")), lambda t: F.contains(t, F.lit(NOTE_MARK))), F.lit(0)).alias("methodology"),
        F.get(_texts(_named("page_author")), F.lit(0)).alias("__author"),
        F.coalesce(
            text.blank_to_null(F.get(_texts(_named("page_email")), F.lit(0))),
            text.mailto_address(F.get(_texts(_named("page_mailto")), F.lit(0))),
        ).alias("page_email"),
    )
    def of_figure(captures: str, image: Column) -> Column:
        """The first capture within the image's own figure."""
        return F.get(F.filter(captures, lambda c: c["figure"] == image["figure"]), F.lit(0))

    images = F.transform(
        "__images",
        lambda c: F.struct(
            _attribute(c, "src").alias("src"),
            text.absolute_url(_attribute(c, "src"), _rule("base_url")).alias("url"),
            F.coalesce(_attribute(c, "alt"), F.lit("")).alias("alt"),
            F.coalesce(of_figure("__captions", c)["text"], F.lit("")).alias("caption"),
            _attribute(of_figure("__figures", c), "data-idxno").alias("idxno"),
        ),
    )
    return staged.withColumns(
        {
            "images": images,
            "links": first_by_href(F.col("__links")),
            "page_author": text.byline_author(F.col("__author")),
        }
    ).drop("__images", "__figures", "__captions", "__links", "__author")


def with_body(candidates: DataFrame) -> DataFrame:
    """Adds ``content`` and ``byline`` by each site's keep rules, from candidate columns."""
    squeezed = F.transform("paragraphs", text.squeeze)
    tails = fv.REPORTER_TAIL_PATTERNS

    def untailed(paragraphs: Column, patterns: list[str]) -> Column:
        cut = F.transform(paragraphs, lambda p: text.py_strip(text.drop_reporter_tail(p, patterns)))
        return F.when(_rule("reporter_tail"), cut).otherwise(paragraphs)

    def kept(paragraphs: Column, floor: str, drop: str) -> Column:
        return F.filter(paragraphs, lambda p: (F.length(p) > _rule(floor)) & ~F.rlike(p, _rule(drop)))

    main = candidates.withColumn("__main", kept(untailed(squeezed, tails), "longer_than", "drop")).withColumn(
        "__main", F.when(_rule("first").isNotNull(), F.slice("__main", F.lit(1), _rule("first"))).otherwise(F.col("__main"))
    )
    spare = main.withColumn("__spare", kept(untailed(F.col("fallbacks"), tails[:2]), "fallback_longer_than", "fallback_drop"))
    spare = spare.withColumn(
        "__spare", F.when(_rule("drop_contained"), text.drop_contained(F.col("__spare"))).otherwise(F.col("__spare"))
    )
    blocks = F.transform(F.split("whole_text", r"\n\s*\n"), lambda b: text.squeeze(text.py_strip(b)))
    whole = (
        F.when(_rule("whole_blocks"), F.filter(blocks, lambda b: F.length(b) > _rule("longer_than")))
        .when(F.length("whole_text") > _rule("whole_longer_than"), F.array("whole_text"))
        .otherwise(F.array().cast("array<string>"))
    )
    chosen = spare.withColumn(
        "__chosen",
        F.when(F.size("__main") > 0, F.col("__main")).when(F.size("__spare") > 0, F.col("__spare")).otherwise(whole),
    )
    split = chosen.withColumn("__split", text.split_tail_byline(F.col("__chosen"), lambda p: F.rlike(p, _rule("byline"))))
    joined = split.withColumn("__joined", F.call_function("array_join", F.col("__split.paragraphs"), _rule("joiner")))
    content = (
        F.when(_rule("wire"), text.clean_wire(F.col("__joined")))
        .when(_rule("squeeze"), text.squeeze(F.col("__joined")))
        .otherwise(F.col("__joined"))
    )
    return joined.withColumns(
        {"content": F.coalesce(text.py_strip(content), F.lit("")), "byline": F.col("__split.byline")}
    ).drop("__main", "__spare", "__chosen", "__split", "__joined")


def extract_articles(pages: DataFrame, as_of: Column, rules: Mapping[str, dict] = SITE_RULES) -> DataFrame:
    """Article pages to ``content``, ``published_at``, byline and rich fields; one narrow stage, no shuffle."""
    bodied = with_body(article_candidates(pages, rules))
    return bodied.withColumn("__date", dates.resolve_published(F.col("date_texts"), as_of)).select(
        *[c for c in pages.columns if c != "html"],
        "container_found",
        "content",
        "__date.published_at",
        "__date.date_defaulted",
        "byline",
        F.coalesce("page_author", text.byline_author(F.col("byline"))).alias("author"),
        F.coalesce("page_email", text.byline_email(F.col("byline"))).alias("email"),
        "page_title",
        "__date.updated_at",
        "headings",
        "outline",
        "images",
        F.get("images", F.lit(0)).alias("lead_image"),
        "links",
        "methodology",
    )
