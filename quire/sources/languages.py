"""English names of languages by code, built from the platform's own tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The languages that are known, by two-letter code; codes that differ from the platform's
# three-letter ones or come beside them; codes that are not known; names that differ from the platform's.
KNOWN = """ar he fa ur ps ku id ms th vi tl km lo my zh ja ko hi bn ta te mr gu pa si ne en fr de es it pt nl ru pl cs
sv da fi nb ro hu el tr uk bg hr sk sr lt lv et ca sw am so ha yo hy ka az kk uz""".split()
MORE = {
    "per": "fa", "farsi": "fa", "persian": "fa", "bahasa indonesia": "id", "bahasa": "id", "mal": "ms", "fil": "tl", "tagalog": "tl",
    "bur": "my", "chi": "zh", "fre": "fr", "ger": "de", "dut": "nl", "cze": "cs", "nor": "nb", "rum": "ro", "gre": "el", "slo": "sk", "arm": "hy", "geo": "ka",
}
NOT_KNOWN = ["mya", "nob", "tgl", "hye", "kat"]
NAMES = {"fa": "Persian (Farsi)", "tl": "Filipino", "nb": "Norwegian", "bn": "Bengali", "zh-hans": "Chinese (Simplified)", "zh-hant": "Chinese (Traditional)", "unknown": "Unknown"}


def language_names(spark: SparkSession) -> dict[str, str]:
    """Two- and three-letter codes and English names, lower case, to the English name."""
    locale = spark._jvm.java.util.Locale
    names: dict[str, str] = {}
    for code in KNOWN:
        one = locale.forLanguageTag(code)
        name = NAMES.get(code) or one.getDisplayLanguage(locale.ENGLISH)
        names |= {code: name, one.getISO3Language(): name, name.lower(): name}
    for code in [*NOT_KNOWN, NAMES["fa"].lower()]:
        names.pop(code, None)
    return names | {code: names[of] for code, of in MORE.items()} | {k: v for k, v in NAMES.items() if k not in KNOWN}
