"""Word lists of the listing domain. A job may pass its own; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
SYNONYMS = (
    ("鼎家", "頂加"), ("鼎加", "頂加"), ("頂家", "頂加"), ("頂樓加蓋", "頂加"), ("頂樓增建", "頂加"), ("7+8", "頂加"),
    ("7＋8", "頂加"), ("七加八", "頂加"), ("美寓", "公寓"), ("大陽台", "陽台"), ("前後大陽台", "前後陽台"),
)
ROAD_ALIASES = (("中山路2段", "中山路二段"), ("三民路1段", "三民路一段"), ("三民路2段", "三民路二段"))
FEATURES = {
    "埔墘": ("埔墘",), "家樂福": ("家樂福",), "光復學區": ("光復學區", "光復國小"), "公寓": ("公寓",), "電梯": ("電梯",),
    "頂加": ("頂加",), "一樓": ("1樓", "一樓"), "二樓": ("2樓", "二樓"), "三樓": ("3樓", "三樓"), "三房": ("3房", "三房"),
    "四房": ("4房", "四房"), "方正": ("方正",), "邊間": ("邊間",), "三面採光": ("三面採光",), "前後陽台": ("前後陽台",),
    "天然瓦斯": ("天然瓦斯",), "內外梯": ("內外梯", "內外樓梯"), "景觀": ("景觀",), "雙車位": ("雙車位", "雙平車", "雙坡平"),
    "地下室": ("地下室",), "店面": ("店面",), "透天": ("透天",), "收租": ("收租",),
}
HIGH_SIGNAL = (
    "公寓", "電梯", "頂加", "三面採光", "內外梯", "雙車位", "地下室", "三房", "四房", "方正", "邊間", "前後陽台", "天然瓦斯",
    "一樓", "二樓", "三樓", "店面", "透天", "收租",
)
EARLY_FEATURES = ("埔墘", "電梯", "頂加", "三面採光", "內外梯", "邊間", "景觀", "四房", "雙車位")
STRUCTURE = ("頂加", "三面採光", "內外梯", "雙車位")
KEYWORDS = (
    "收租", "頂加", "露台", "露臺", "店面", "店辦", "透天", "邊間", "河景", "景觀", "採光", "三房", "四房", "兩房", "公寓",
    "電梯", "一樓", "頂樓",
)
STOPWORDS = (
    "板橋", "板橋區", "新北市", "永慶房屋", "公司", "專約", "專任", "推薦", "好宅", "美寓", "美屋", "美宅", "公寓", "華廈",
    "大樓", "住宅", "捷運", "邊間", "採光", "三房", "兩房", "四房", "一樓", "二樓", "三樓", "四樓", "五樓", "全新", "裝潢",
    "首購", "成家", "稀有", "景觀", "低總價", "近捷運", "出價可談",
)
GENERIC_PREFIXES = ("", "板橋", "中山路二段", "三民路一段", "三民路二段", "光復街", "萬安街", "林森街", "翠華街")
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
BADGES = ("AI煥裝", "AI導覽", "優質", "新上架", "降價")
BUTTONS = ("看地圖", "詳情", "收藏")
DISTRICT, CITY = "板橋區", "新北市"


@dataclass(frozen=True)
class Lexicon:
    synonyms: tuple = SYNONYMS
    aliases: tuple = ROAD_ALIASES
    features: dict = field(default_factory=lambda: dict(FEATURES))
    stopwords: tuple = STOPWORDS
    generic: tuple = GENERIC_PREFIXES
    numerals: dict = field(default_factory=lambda: dict(NUMERALS))
    badges: tuple = BADGES
    buttons: tuple = BUTTONS
    district: str = DISTRICT
    city: str = CITY


# The words of the earlier rule.
EARLY_LEXICON = Lexicon(
    synonyms=(("鼎家", "頂加"), ("鼎加", "頂加"), ("頂樓加蓋", "頂加"), ("頂樓增建", "頂加"), ("7+8", "頂加"), ("7＋8", "頂加"), ("七加八", "頂加")),
    features={
        "埔墘": ("埔墘",), "電梯": ("電梯",), "頂加": ("頂加",), "三面採光": ("三面採光",), "內外梯": ("內外梯", "內外樓梯"), "邊間": ("邊間",),
        "景觀": ("景觀",), "四房": ("4房", "四房"), "雙車位": ("雙車位", "雙平車", "雙坡平"),
    },
    generic=(),
)
