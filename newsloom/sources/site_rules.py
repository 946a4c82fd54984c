"""FIXED VALUES: where each news site keeps list items, body text, dates and media.

``body``: container selectors in order of trust, what to leave out, how text nodes are joined
(``""`` / ``" "`` / ``"\\n"``, or ``None`` for the raw text), paragraph and fallback selectors.
``list``: item selectors and the fields of an item, each with selectors in order of trust.
``dates``: page-level places of the publication date in order of trust; the part after ``@`` is an attribute.
``keep``: floor on paragraph length, patterns of paragraphs to drop, joiner, page cap.
"""

CONTAINER_LADDER = [
    "section.article-body", "div#article-body", "div.article-body", "article.article-body",
    ".story-news", ".article-content", "main", "article",
]
META_PUBLISHED = 'meta[property="article:published_time"]@content'

SITE_RULES = {
    "chosun": {
        "base_url": "https://www.chosun.com",
        "body": {"containers": CONTAINER_LADDER, "exclude": [], "join": None, "paragraph": ["p"], "fallback": []},
        "keep": {"longer_than": 20, "fallback_longer_than": 20, "drop": [], "joiner": "\n\n", "first": 20},
        "dates": [META_PUBLISHED],
    },
    "donga": {
        "base_url": "https://www.donga.com",
        "list": {
            "items": ["div.divide_area section.sub_news_sec ul.row_list li"],
            "title": ["h4.tit a@data-ep_button_name", "h4.tit a@data-ep_contentdata_content_title", "h4.tit a",
                      "header.news_head a@data-ep_button_name", "article.news_card a img@alt"],
            "link": ["h4.tit a@href", "header.news_head a@href", "article.news_card a@href"],
            "section": ["h4.tit a@data-ep_button_category", "header.news_head a@data-ep_button_category"],
            "per_page": 10, "min_title": True,
        },
        "body": {
            "containers": ["section.news_view", "div.view_body"],
            "exclude": ["h2.sub_tit", "figure", "img", "figcaption", ".view_m_adK", ".view_ad06", ".view_m_adA",
                        ".view_m_adB", ".a1", ".view_series", ".view_trend", "script", "style"],
            "join": "", "paragraph": ["p"], "fallback": ["div"],
        },
        "keep": {"longer_than": 20, "fallback_longer_than": 50, "whole_longer_than": 100, "drop": [],
                 "joiner": " ", "squeeze": True, "drop_contained": True},
        "dates": ['span[aria-hidden="true"]', "time[datetime]@datetime", ".date", ".time", ".publish_date",
                  ".article_date"],
    },
    "joongang": {
        "base_url": "https://www.joongang.co.kr",
        "list": {
            "items": ["ul#story_list li.card"],
            "title": ["h2.headline a"], "link": ["h2.headline a@href"], "per_page": 24,
        },
        "body": {
            "containers": ["div#article_body"],
            "exclude": ["#ad_art_content_mid", ".ad", ".advertisement", ".ab_photo", ".ab_byline",
                        "section.related_link", ".caption", 'div[class*="ad"]', ".article_photo_wrap"],
            "join": "", "paragraph": ["p[data-divno]"], "fallback": ["p"],
        },
        "keep": {"longer_than": 5, "fallback_longer_than": 15, "drop": [],
                 "fallback_drop": ["기자", "@", "출처:", "사진=", "그래픽="], "joiner": "\n\n", "squeeze": True,
                 "order_by": "data-divno"},
        "dates": ['time[itemprop="datePublished"]@datetime', "time[datetime]@datetime", "button.btn_datetime span",
                  ".article_info .date", ".article_info .time", ".date_info", ".article_date", ".publish_date"],
    },
    "khan": {
        "base_url": "https://www.khan.co.kr",
        "list": {
            "items": ["ul#recentList li article"],
            "title": ["a[href]"], "link": ["a[href]@href"], "description": ["p.desc"], "date": ["p.date"],
            "image": ["img@src"], "image_alt": ["img@alt"], "min_title": True,
        },
        "body": {
            "containers": ["div#articleBody"],
            "exclude": ["div.editor-subtitle", "div.art_photo", "p.caption", 'div[class*="banner-article"]',
                        "div.srch-kw", 'div[class*="banner"]', 'div[class*="ad"]', 'div[class*="advertisement"]',
                        "script", "style", "noscript", "iframe"],
            "join": "", "paragraph": ["p.content_text"], "fallback": [],
        },
        "keep": {"longer_than": 10, "drop": [r"[가-힣]+\s*기자", r"[가-힣]+\s*특파원", r"[가-힣]+\s*통신원", "@",
                                             r"\[출처:", r"\[경향신문\]"], "joiner": "\n\n"},
        "dates": ["time[datetime]@datetime", META_PUBLISHED, 'a[title*="기사 입력/수정일"] p', ".article-date p",
                  ".date p", ".publish_date p"],
    },
    "naeil": {
        "base_url": "https://www.naeil.com",
        "list": {
            "items": [".sub-news-list-wrap ul.story-list li.card.card-box"],
            "title": [".card-text .headline a"], "link": [".card-text .headline a@href"],
            "description": [".card-text .description a"], "year": [".card-body .meta .year"],
            "month_day": [".card-body .meta .date"], "image": [".card-image img@data-src", ".card-image img@src"],
            "image_alt": [".card-image img@alt"], "min_title": True,
        },
        "body": {
            "containers": ["div.article-view"],
            "exclude": ["div.article-subtitle", "div.article-photo-wrap", "figure", "figcaption", "script", "style",
                        "noscript", "iframe", "aside", '[class^="ad-"]', "[data-svcad]"],
            "join": "", "paragraph": ["p"], "fallback": [],
        },
        "keep": {"longer_than": 5, "drop": [r"(?s)^(?=.*기자)(?=.*@)", r"^(?:\S+\s+){0,2}\S*기자$", "^저작권",
                                            "^Copyright"], "joiner": "\n\n",
                 "byline": r"(?U)\w+\s*기자|(?s)(?=.*기자).*@"},
        "dates": ["header.article-header .group .datetime .date", META_PUBLISHED, 'meta[name="pubdate"]@content',
                  'meta[name="date"]@content', 'meta[name="ptime"]@content', "time[datetime]@datetime"],
    },
    "munhwa": {
        "base_url": "https://www.munhwa.com",
        "list": {
            "items": ["li[data-li]"],
            "title": ["h4.title a", "h4.title", "a[href]"], "link": ["a[href]@href"], "date": ["span.date"],
            "author": ["span.writer"], "description": ["p.description a"], "min_title": True,
        },
        "body": {
            "containers": ["#article-body"],
            "exclude": ["script", "style", "noscript", ".article-photo-wrap", ".article-subtitle", "figure",
                        "figcaption", "[data-svcad]", '[id^="svcad_"]', '[id*="svcad"]', '[class^="ad-"]',
                        '[class*="ad-"]', "ins", "iframe", 'div[id^="svcad"]'],
            "join": "", "paragraph": ["p.text-l"], "fallback": ["p"],
        },
        "keep": {"longer_than": 10, "fallback_longer_than": 20, "drop": [], "joiner": "\n\n", "squeeze": True,
                 "reporter_tail": True},
        "dates": [META_PUBLISHED, ".date", ".publish-date", ".article-date", '[class*="date"]'],
    },
    "pressian": {
        "base_url": "https://www.pressian.com",
        "list": {
            "items": [".arl_022 ul.list > li"],
            "title": ["p.title a[href]"], "link": ["p.title a[href]@href"], "subtitle": ["p.sub_title a"],
            "description": ["p.body a"], "author": [".byline .name"], "date": [".byline .date"],
            "style": [".thumb .arl_img@style"], "min_title": True,
        },
        "body": {
            "containers": ['.section .article_body[itemprop="articleBody"]', ".article_body"],
            "exclude": ["script", "style", "noscript", "figure", "figcaption", "img", ".article_ad", ".article_ad2",
                        '[class^="ads"]', "ins.adsbygoogle", "iframe", '[id^="google_ads_"]'],
            "join": "", "paragraph": ["p"], "fallback": [],
        },
        "keep": {"longer_than": 10, "drop": [], "joiner": "\n\n"},
        "dates": [".byline .date", META_PUBLISHED],
        "page_fields": {"author": [".list_author .byline .name"],
                        "email": [".list_author .byline .mail .tooltip"],
                        "mailto": ['.list_author .byline a[href^="mailto:"]@href']},
    },
    "hankyung": {
        "base_url": "https://www.hankyung.com",
        "list": {
            "items": [".allnews-wrap .allnews-panel ul.allnews-list > li[data-aid]"],
            "title": ["h2.news-tit a[href]"], "link": ["h2.news-tit a[href]@href"], "date": [".txt-date"],
            "image": [".thumb img@src"], "image_alt": [".thumb img@alt"], "min_title": True, "unique_id": True,
        },
        "body": {
            "containers": ['.article-body#articletxt[itemprop="articleBody"]'],
            "exclude": ["script", "style", "noscript", "iframe", ".ad-area-wrap", '[id^="div-gpt-ad"]', "ins",
                        "figure img", "figure figcaption"],
            "join": "", "paragraph": ["p"], "fallback": [], "break_lines": True,
        },
        "keep": {"longer_than": 10, "whole_blocks": True, "drop": [], "joiner": "\n\n",
                 "byline": r"(?s)^(?=.*기자).{0,49}$|@"},
        "dates": [".txt-date", META_PUBLISHED],
    },
    "segye": {
        "base_url": "https://www.segye.com",
        "list": {
            "items": ["li"],
            "title": ["a strong.tit", "a[href]"], "link": ["a[href]@href"], "date": ["small.date"],
            "description": ["a span.cont"], "min_title": True,
        },
        "body": {
            "containers": ["article.viewBox2"],
            "exclude": ["em.precis", "figure", "figcaption", "aside", ".newsct_journalist", "p.copyright", "script",
                        "style", "noscript", "ins.adsbygoogle", "iframe", "#outerDiv"],
            "join": "", "paragraph": ["p"], "fallback": [],
        },
        "keep": {"longer_than": 5, "drop": ["^저작권", "^Copyright", "^ⓒ", "(?s)기자.{0,8}$", "@"], "joiner": "\n\n"},
        "dates": ["$datePublished", META_PUBLISHED, "time[datetime]@datetime", ".date", ".time", ".publish_date",
                  ".article_date", ".news_date"],
    },
    "sisain": {
        "base_url": "https://www.sisain.co.kr",
        "list": {
            "items": ["ul.type li.items"],
            "title": ["div.view-cont h2.titles a"], "link": ["div.view-cont h2.titles a@href"],
            "description": ["p.lead.line-x2 a"], "date": ["em.replace-date"], "image": ["a.thumb img@src"],
            "image_alt": ["a.thumb img@alt"],
        },
        "body": {
            "containers": ['article#article-view-content-div.article-veiw-body[itemprop="articleBody"]',
                           'article.article-veiw-body[itemprop="articleBody"]'],
            "exclude": ["script", "style", "noscript", "iframe", ".ad-template", "ins.adsbygoogle", '[id^="AD"]',
                        ".IMGFLOATING", '[style*="display:none"]'],
            "join": "", "paragraph": ["p"], "fallback": [],
        },
        "keep": {"longer_than": 10, "drop": [], "joiner": "\n\n"},
        "dates": [META_PUBLISHED, "em.replace-date"],
    },
    "ohmynews": {
        "base_url": "https://www.ohmynews.com",
        "list": {"items": [".news_list"], "title": ["dt a"], "link": ["dt a@href"], "per_page": 20},
        "body": {
            "containers": ['div.at_contents[itemprop="articleBody"]'],
            "exclude": ["figure", "script", "style", "iframe", "button", "img", "video", "audio",
                        'div[class*="ad"]'],
            "join": "\n", "paragraph": [], "fallback": [],
        },
        "keep": {"longer_than": 0, "whole_longer_than": 0, "drop": [], "joiner": "\n"},
        "dates": ["span.date", ".article_date", ".date_time", ".publish_time"],
    },
    "newsis": {
        "base_url": "https://www.newsis.com",
        "list": {"items": [".txtCont"], "title": [".tit a"], "link": [".tit a@href"], "per_page": 20},
        "body": {
            "containers": ["article"],
            "exclude": ["div.summury", "div#textBody", "iframe", "script", "div#view_ad", "img", "p.photojournal"],
            "join": " ", "paragraph": [], "fallback": [],
        },
        "keep": {"longer_than": 0, "whole_longer_than": 0, "drop": [], "joiner": " ", "wire": True},
        "dates": [META_PUBLISHED, "span"],
    },
    "yonhap": {
        "base_url": "https://www.yna.co.kr",
        "list": {"items": ["div.item-box01"], "title": ["a.tit-news span.title01"], "link": ["a.tit-news@href"],
                 "per_page": 15},
        "body": {
            "containers": [".story-news.article"],
            "exclude": ["aside", "figure", "div.comp-box", "p.txt-copyright"],
            "join": " ", "paragraph": ["p"], "fallback": [],
        },
        "keep": {"longer_than": 0, "drop": ["저작권자", "무단 전재", "제보는 카카오톡", r"^\[.*\]$",
                                            r"[a-zA-Z0-9._%+-]+@yna\.co\.kr"], "joiner": "\n\n"},
        "dates": ["p.txt-time01"],
    },
    "hani": {
        "base_url": "https://www.hani.co.kr",
        "list": {
            "items": [".ArticleList_item___OGQO"],
            "title": [".BaseArticleCard_title__TVFqt"], "link": [".BaseArticleCard_link__Q3YFK@href"],
            "date": [".BaseArticleCard_date__4R8Ru"],
        },
        "body": {
            "containers": ["div.article-text"],
            "exclude": ['[class*="ArticleDetailAudioPlayer"]', '[class*="ArticleDetailContent_adWrap"]',
                        '[class*="ArticleDetailContent_adFlex"]', '[class*="BaseAd_"]', "figure", "script", "style",
                        "noscript", "iframe", "img"],
            "join": None, "paragraph": ["p.text"], "fallback": [],
        },
        "keep": {"longer_than": 0, "drop": [r"(?is)^(?=.*@)(?=.*(?:기자|reporter))"], "joiner": "\n\n"},
        "dates": [".date", META_PUBLISHED],
    },
}

# Plain pages without a rule of their own: one article element with paragraphs, links in a navigation list.
PLAIN_RULE = {
    "base_url": "",
    "list": {"items": ["nav ul li"], "title": ["a"], "link": ["a@href"]},
    "body": {"containers": ["article", "main", "body"], "exclude": ["nav", "footer", "div.ad", "script", "style"],
             "join": " ", "paragraph": ["p"], "fallback": ["div"]},
    "keep": {"longer_than": 10, "fallback_longer_than": 50, "drop": [], "joiner": "\n\n"},
    "dates": [META_PUBLISHED, "time[datetime]@datetime"],
}

# Rich bodies: places of headings, figures, links and the methodology note inside the container.
RICH_FIELDS = {
    "heading": ["h1", "h2", "h3", "h4", "h5", "h6"],
    "image": ["figure img"],
    "caption": ["figure figcaption"],
    "figure": ["figure"],
    "link": ["p a[href]"],
    "note": ['p span[style*="color:#2980b9"]'],
}
NOTE_MARK = "■ 이렇게 조사했다"
