"""Values that results depend on: word lists, patterns, formats and texts.

Everything in this module is a FIXED VALUE, written out plainly: changing one changes results.
Rules that name people are data, kept in ``newsloom/data``.
"""

# Keyword taxonomy, in order of precedence; weights and threshold of the score.
CATEGORY_KEYWORDS = {
    "국회/정당": ["국회", "의원", "정당", "여당", "야당", "국정감사", "상임위"],
    "행정부": ["정부", "대통령", "총리", "부처", "장관", "청와대", "국무회의"],
    "선거": ["선거", "투표", "후보", "당선", "득표", "선거구", "공천", "지방선거"],
    "사법/검찰": ["검찰", "법원", "재판", "기소", "수사", "판결", "검사", "특검", "헌재", "탄핵"],
    "정책/경제사회": ["정책", "예산", "법안", "개혁", "경제", "복지", "노동", "사회"],
    "외교/안보": ["외교", "안보", "국방", "북한", "미국", "중국", "일본", "한미", "한일", "군사"],
    "지역정치": ["지역", "시도", "시장", "도지사", "구청장", "지자체", "지방", "도의회", "광역의회"],
}
OTHER_CATEGORY = "기타"
TITLE_WEIGHT = 2.0
LEAD_WEIGHT = 1.0
SCORE_THRESHOLD = 1.0
NO_BODY_REASON = "본문 없음"

# Noise patterns, applied in this order (pattern, replacement).
# The space class is Unicode white space plus the four separators U+001C to U+001F.
SPACE_CLASS = r"[ \p{IsWhite_Space}\x1c-\x1f]"
SPACE_CHARS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NOISE_PATTERNS = [
    (r"\([^)]*\)", ""),
    (r"[가-힣]{2,4}" + SPACE_CLASS + r"*기자" + SPACE_CLASS + r"*=", ""),
    (r"\[[^\]]*\]", ""),
    (r"[◇【】…]", ""),
    (r"<[^>]*>", ""),
    (r"&[a-zA-Z0-9#]+;", ""),
    (SPACE_CLASS + "+", " "),
]
TITLE_NOISE_PATTERNS = [
    (
        r"\[(속보|단독|기획|특집|인터뷰|분석|해설|논평|사설|칼럼|기고|오피니언|포토|영상|동영상|인포그래픽)\]",
        "",
    ),
    (r"^[가-힣]{1,2}" + SPACE_CLASS + r"*(기자|특파원)" + SPACE_CLASS + r"*[:=]?", ""),
    (r"[◆◇▲△●○■□★☆▶◀◁▷①②③④⑤⑥⑦⑧⑨⑩]+", ""),
    (r"^\[.*?\]", ""),
    (r"^\(.*?\)", ""),
    (r"^<.*?>", ""),
    (SPACE_CLASS + "+", " "),
]
LEAD_FALLBACK_CHARS = 100

# Wire-agency boilerplate and trailing reporter names.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
WIRE_PATTERNS = [
    (r"[가-힣]+" + SPACE_CLASS + r"*기자" + SPACE_CLASS + "*=?" + SPACE_CLASS + "*", ""),
    (EMAIL_PATTERN, ""),
    (r"\[뉴시스\]", ""),
    (r"(?d)◎공감언론" + SPACE_CLASS + r"*뉴시스.*", ""),
    (r"(?d)\*재판매.*", ""),
    (r"(?d)photo@newsis\.com.*", ""),
    (r"\n" + SPACE_CLASS + r"*\n", "\n"),
    (SPACE_CLASS + "+", " "),
]
REPORTER_TAIL_PATTERNS = [
    r"(?dmU)…\s*\w+\s*기자\s*$",
    r"(?dmU)\w+\s*기자\s*$",
    r"(?dmU)기자\s*\w+\s*$",
]
MARKUP_PATTERNS = [
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]+>", ""),
    (SPACE_CLASS + "+", " "),
]

# Filters of the save path.
MIN_BODY_CHARS = 20
MIN_TITLE_CHARS = 10
SKIP_BODY_PREFIXES = ["■ 방송", "〈시사IN〉은"]
SKIP_TITLE_SUFFIXES = ["[김은지의 뉴스IN]"]
SKIP_RULE_SOURCE = "sisain"
TARGET_ARTICLES = 160
RECENT_DAYS = 7

# Words, word classes and default phrases of headlines.
HANGUL_WORD = r"[가-힣]{2,}"
WORD_CLASSES = {
    "person": [
        r"^[가-힣]{2,3}$",
        r"^[가-힣]+대통령$",
        r"^[가-힣]+의원$",
        r"^[가-힣]+장$",
        r"^[가-힣]+총리$",
        r"^[가-힣]+원장$",
    ],
    "position": [
        r"부$", r"청$", r"원$", r"당$", r"국$",
        r"대법원장", r"검찰청장", r"국정원장", r"경찰청장",
    ],
    "event": [
        r"의혹$", r"사건$", r"논란$", r"특검$", r"탄핵$",
        r"구속$", r"수사$", r"청탁$", r"회동$", r"만남$",
    ],
    "reaction": [
        r"반발$", r"비판$", r"규탄$", r"압박$", r"공방$",
        r"대응$", r"입장$", r"발표$", r"거부$", r"수용$",
    ],
}
CLASSED_WORDS = 20
MIN_WORD_COUNT = 2
DEFAULT_HEADLINE = "정치 이슈"
DEFAULT_GROUP_HEADLINE = "정치 현안"
ONE_WORD_SUFFIX = "이슈"
DEFAULT_EVENT = "이슈"
DEFAULT_REACTION = "논란"

# Truncation (longest kept length, characters kept, tail).
SHORT_TITLE = (20, 18, "..")
ISSUE_TITLE = (30, 28, "..")
LONG_TEXT = (300, 297, "...")
CELL_TEXT = (30, 27, "...")

# Clustering and ranking parameters.
MIN_CATEGORY_ARTICLES = 30
REDUCED_DIMENSIONS = 15
MIN_SAMPLES = 6
MIN_CLUSTER_SIZE = 15
PATTERN_TITLES = 50
PROMPT_TITLES = 10
MIN_EVENT_KEYWORDS = 2
MIN_GROUP_ARTICLES = 3
MIN_QUALITY_ARTICLES = 20
EVENT_BONUS = 10
MERGED_BONUS = 5
TOP_GROUPS = 3
REPRESENTATIVES = 3
FULL_CONTEXT_ARTICLES = 5
CONTEXT_CHARS = 1000
MIN_PERSPECTIVE_ARTICLES = 3
EMBEDDING_BATCH = 50
SAVE_SUCCESS_FLOOR = 0.9

# Outlet leanings with a bucket of their own, and the default leaning.
BIAS_BUCKETS = ["left", "center", "right"]
DEFAULT_BIAS = "center"

# Texts written when there is no model answer.
NO_TITLES_SUMMARY = "정치 이슈에 대한 논의가 계속되고 있다."
FALLBACK_SUMMARY = "정치권에서 %d개 언론사가 보도한 이슈에 대한 논의가 진행 중이다."
FALLBACK_PERSPECTIVE = {
    "left": "진보 성향 언론사들의 관점 분석 중 오류가 발생했습니다.",
    "right": "보수 성향 언론사들의 관점 분석 중 오류가 발생했습니다.",
}
TOO_FEW_PERSPECTIVE = {
    "left": "좌파 성향 기사가 부족하여 관점 분석이 제한됩니다.",
    "right": "우파 성향 기사가 부족하여 관점 분석이 제한됩니다.",
}

# Layout of model inputs.
ARTICLE_BLOCK = "기사 %d:\n%s\n\n"
TITLED_ARTICLE_BLOCK = "기사 %d: %s\n%s\n\n"
REPRESENTATIVE_HEADER = "=== 대표 기사 ===\n"
OTHER_TITLES_HEADER = "=== 기타 기사 제목 ===\n"
KEYWORD_BLOCK = "\n인물: %s\n직책/기관: %s\n사건/의혹: %s\n반응/태도: %s\n"

# Report formats.
LABEL_FLOOR_PCT = 15
CARD_DATE_FORMAT = "yyyy년 MM월 dd일"
CARD_COUNT_LINE = "%d개 기사 ∙ %s"

# Date words and zones.
HOME_ZONE = "Asia/Seoul"
PUBLISHED_WORDS = ["게재", "입력", "등록"]
UPDATED_WORDS = ["수정", "최종수정"]
DATE_LABEL_PATTERN = r"(최종\s*업데이트|기사입력|수정)"
RELATIVE_UNITS = [("분", "minute"), ("시간", "hour"), ("일", "day"), ("주", "week")]
