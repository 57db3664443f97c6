"""License scans by ordered signature rules.

Hundreds of regular expressions, made from a table of licenses and a few forms of
sentence, each tied to a keyword. A document is tested for the keywords once; only
rules whose keyword it holds run. Where detections overlap, one that lies inside
another of the same or a higher priority is suppressed.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, lower_ascii, quoted, text_or_empty
from awardtrace.llm.spans import before, let, spans

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, keyword, pattern of the name, pattern of the identifier, pattern of the address (all in lower case).
LICENSES = [
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e,? (?:version |v)?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e(?:,? (?:version |v)?2(?:\.0)?)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit", r"mit(?:/expat)? licen[sc]e", r"mit", r"opensource\.org/licen[sc]es?/mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?", r"mit-0", r"opensource\.org/licen[sc]es?/mit-0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd[ -]2[ -]clause|2[ -]clause bsd)(?: licen[sc]e)?", r"bsd-2-clause", r"opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd[ -]3[ -]clause|3[ -]clause bsd)(?: licen[sc]e)?", r"bsd-3-clause", r"opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd[ -]4[ -]clause|4[ -]clause bsd)(?: licen[sc]e)?", r"bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", "bsd", r"bsd licen[sc]e", r"bsd", r"opensource\.org/licen[sc]es?/bsd-license"),
    ("gpl-1.0", "gpl|general public", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v)1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "gpl|general public", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v)2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl|general public", r"(?:gnu )?(?:general public licen[sc]e|gpl),? ?(?:version |v)3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.0", "lgpl|general public", r"(?:gnu )?(?:library general public licen[sc]e|lgpl),? ?(?:version |v)2(?:\.0)?", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "lgpl|general public", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v)2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl|general public", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl),? ?(?:version |v)3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "agpl|affero", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?:,? ?(?:version |v)3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", "free documentation|gfdl|fdl", r"(?:gnu )?free documentation licen[sc]e", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("mpl-1.1", "mozilla|mpl", r"(?:mozilla public licen[sc]e|mpl),? ?(?:version |v)1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla|mpl", r"(?:mozilla public licen[sc]e|mpl),? ?(?:version |v)2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", "eclipse|epl", r"eclipse public licen[sc]e,? ?(?:-|version |v)? ?1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse|epl", r"eclipse public licen[sc]e,? ?(?:-|version |v)? ?2(?:\.0)?", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl-1.0", "cddl|common development", r"(?:common development and distribution licen[sc]e|cddl)", r"cddl-1\.[01]", r"opensource\.org/licen[sc]es?/cddl"),
    ("eupl-1.2", "eupl|european union|joinup", r"(?:european union public licen[sc]e|eupl)", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/[^ ]*eupl"),
    ("isc", "isc", r"isc licen[sc]e", r"isc", r"opensource\.org/licen[sc]es?/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib", r"zlib\.net/zlib_license"),
    ("boost-1.0", "boost|bsl", r"boost software licen[sc]e", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e", r"artistic-[12]\.0", r"opensource\.org/licen[sc]es?/artistic"),
    ("python-2.0", "python|psf", r"python software foundation licen[sc]e|psf licen[sc]e", r"(?:python-2\.0|psf-2\.0)", r"docs\.python\.org/[^ ]*license"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql", r"postgresql\.org/about/licence"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl|do what", r"do what the f[u*]ck you want to public licen[sc]e|wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("0bsd", "0bsd|zero", r"zero[ -]clause bsd(?: licen[sc]e)?", r"0bsd", r"opensource\.org/licen[sc]es?/0bsd"),
    ("cc0-1.0", "cc0|creative", r"(?:creative commons zero|cc0)(?: 1\.0)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-4.0", "creative|cc by|cc-by", r"(?:creative commons attribution|cc[ -]by)(?: international)? [1-4]\.[05]", r"cc-by-[1-4]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "creative|cc by|cc-by", r"(?:creative commons attribution[ -]share[ -]?alike|cc[ -]by[ -]sa)(?: [1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nc", "creative|cc by|cc-by", r"(?:creative commons attribution[ -]non[ -]?commercial|cc[ -]by[ -]nc)(?: [1-4]\.[05])?", r"cc-by-nc-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "creative|cc by|cc-by", r"(?:creative commons attribution[ -]no[ -]?deriv(?:ative)?s|cc[ -]by[ -]nd)(?: [1-4]\.[05])?", r"cc-by-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc-sa", "creative|cc by|cc-by", r"(?:creative commons attribution[ -]non[ -]?commercial[ -]share[ -]?alike|cc[ -]by[ -]nc[ -]sa)(?: [1-4]\.[05])?", r"cc-by-nc-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "creative|cc by|cc-by", r"(?:creative commons attribution[ -]non[ -]?commercial[ -]no[ -]?deriv(?:ative)?s|cc[ -]by[ -]nc[ -]nd)(?: [1-4]\.[05])?", r"cc-by-nc-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-nd"),
    ("odbl", "open database|odbl|opendatacommons", r"open database licen[sc]e|odbl", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons|odc|opendatacommons", r"open data commons attribution(?: licen[sc]e)?", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl", "public domain|pddl|opendatacommons", r"public domain dedication and licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("ofl-1.1", "open font|ofl|scripts", r"(?:sil )?open font licen[sc]e", r"ofl-1\.[01](?:-rfn|-no-rfn)?", r"scripts\.sil\.org/ofl"),
    ("openrail", "openrail|open rail|bigscience|creativeml|huggingface", r"(?:bigscience |creativeml )?open ?rail(?:[ -]?\+*m)?(?: licen[sc]e)?", r"(?:creativeml|bigscience)?-?openrail(?:-m)?", r"huggingface\.co/spaces/[^ ]*license"),
    ("sspl-1.0", "server side|sspl|mongodb", r"server side public licen[sc]e|sspl", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    ("busl-1.1", "business source|busl|mariadb", r"business source licen[sc]e", r"busl-1\.1", r"mariadb\.com/bsl11"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: 2\.0)?", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("ms-pl", "microsoft|ms-pl", r"microsoft public licen[sc]e|ms-pl", r"ms-pl", r"opensource\.org/licen[sc]es?/ms-pl"),
    ("upl-1.0", "universal permissive|upl", r"universal permissive licen[sc]e", r"upl-1\.0", r"opensource\.org/licen[sc]es?/upl"),
]
#: Sentences of licenses and notices: label, keyword, pattern, priority.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 4),
    ("isc", "permission to use", r"permission to use, copy, modify,? and/or distribute this software for any purpose", 4),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification,? are permitted", 4),
    ("gpl", "free software", r"(?:this program is|it is) free software[;:,] you can redistribute it and/or modify", 4),
    ("public-domain", "public domain", r"(?:released (?:in)?to|dedicated to|placed in|is in) the public domain", 4),
    ("proprietary", "proprietary", r"proprietary and confidential", 3),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|distribution)[^.\n]{0,80} (?:is )?(?:strictly )?prohibited", 3),
    ("non-commercial", "non", r"(?:for|free for) (?:personal and )?non[ -]?commercial use(?: only)?", 3),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:[0-9]{4})(?:[-, ]+[0-9]{4})*", 1),
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 1),
]

_GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|offered)(?: to you)? (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


def rules() -> list[tuple[str, str, int, str]]:
    """All rules in order: keyword, label, priority, pattern. Five forms for each license, then the sentences."""
    made = []
    for label, keywords, name, identifier, address in LICENSES:
        for keyword in keywords.split("|"):
            made.append((keyword, label, 5, rf"spdx-license-identifier: *(?:{identifier})(?![\w.-])"))
            made.append((keyword, label, 4, rf"{_GRANT}(?:{name})(?![\w])"))
            made.append((keyword, label, 3, rf"(?<![\w.-])(?:https?://)?(?:www\.)?(?:{address})[^\s]*"))
            made.append((keyword, label, 2, rf"(?<!\w)(?:{name})(?!\w)"))
            made.append((keyword, label, 2, rf"licen[sc]e: *(?:{identifier})(?![\w.-])"))
    made += [(keyword, label, priority, pattern) for label, keyword, pattern, priority in SENTENCES]
    # A space stands for any white space, as sentences run over lines.
    return [(keyword, label, priority, pattern.replace(" ", r"\s")) for keyword, label, priority, pattern in made]


def _starts(words: list[str], boundary: str = "(?<![a-z0-9])") -> str:
    """A pattern for any of the words, behind no letter or digit; by first letter, the longest first."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by_letter.setdefault(w[0], []).append(w[1:].replace(".", r"\.").replace("-", r"\-").replace(" ", r"\s"))
    return boundary + "(?:" + "|".join(f"{x}(?:{'|'.join(rest)})" for x, rest in sorted(by_letter.items())) + ")"


def _anywhere(words: list[str]) -> str:
    return _starts(words, "")


def _keyword_pattern() -> str:
    """Keywords at the start of a word; those that lead a rule without a leading boundary, anywhere."""
    return _starts([r[0] for r in rules()]) + "|" + _anywhere(LEADING)


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PHRASE_GATE = "(?i)" + "|".join(p.replace(" ", _BETWEEN) for p in PHRASES)
#: Keywords with which a rule starts that asks for no word start: text glued to them must not hide them.
LEADING = ["permission is hereby granted", "permission to use", "redistribution and use", "proprietary", "unauthori", "copyright"]
#: Every match of a rule holds one of ANCHORS at the start of a word or one of LOOSE anywhere; few other texts do.
LOOSE = ["license:", "licence:", "permission is hereby granted", "permission to use", "redistribution and use",
         "proprietary and confidential", "unauthorized", "unauthorised", "copyright"]
ANCHORS = [
    "license", "licence", "mit no attribution", "licensed", "licenced", "licensing", "spdx", "unlicense", "copyright", "public domain", "rights reserved",
    "permission is", "permission to", "redistribution and", "free software", "proprietary and", "unauthorized", "unauthorised",
    "non commercial", "non-commercial", "noncommercial", "creative commons", "creativecommons", "cc by", "cc-by", "cc0",
    "gpl", "lgpl", "agpl", "gfdl", "mpl", "cddl", "eupl", "odbl", "sspl", "wtfpl", "ms-pl", "bsd", "0bsd", "gnu.org",
    "open rail", "openrail", "open data commons", "opendatacommons", "mozilla.org", "eclipse.org", "zlib.net", "boost.org",
    "mariadb.com", "mongodb.com", "elastic.co", "scripts.sil", "docs.python", "huggingface.co", "simplified bsd", "modified bsd", "new bsd",
    "original bsd", "zero clause", "zero-clause", "joinup",
]
_ANCHOR_GATE = "(?i)" + _starts(ANCHORS, "(?<![a-zA-Z0-9])") + "|" + _anywhere(LOOSE)
_SPAN = "struct<start:int,end:int,label:string,priority:int>"


def phrase_places(words: Column) -> Column:
    """Places (at, label) where the words of a fixed phrase stand consecutively."""
    def places(words: Column) -> Column:
        def label(word: Column, at: Column) -> Column:
            found = F.lit(None).cast("string")
            for phrase, name in PHRASES.items():
                parts = phrase.split(" ")
                fits = word == parts[0]
                for i, part in enumerate(parts[1:], 1):
                    fits = fits & (F.get(words, at + i) == part)
                found = F.when(fits, name).otherwise(found)
            return F.struct(at.cast("long").alias("at"), found.alias("label"))

        return F.filter(F.transform(words, label), lambda p: p["label"].isNotNull())

    return let(words, places)


def detections(text: Column) -> Column:
    """All matches of the rules whose keyword the text holds, some twice; one scan finds the keywords."""
    by_keyword: dict[str, list[Column]] = {}
    for keyword, label, priority, pattern in rules():
        by_keyword.setdefault(keyword, []).append(
            F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(pattern).alias("pattern")))
    table = F.create_map(*chain.from_iterable((F.lit(k), F.array(*v)) for k, v in by_keyword.items()))
    # The longest keyword at each place; shorter ones inside it are asked for too.
    inside = F.create_map(*chain.from_iterable(
        (F.lit(k), F.array(*[F.lit(x) for x in by_keyword if x in k])) for k in by_keyword))
    words = F.transform(F.regexp_extract_all(text, F.lit(f"(?=({_keyword_pattern()}))"), F.lit(1)),
                        lambda k: F.regexp_replace(k, r"\s", " "))
    held = F.array_distinct(F.flatten(F.transform(F.array_distinct(words), lambda k: F.element_at(inside, k))))
    asked = F.flatten(F.transform(held, lambda k: F.element_at(table, k)))
    return F.flatten(F.transform(asked, lambda r: F.transform(spans(text, r["pattern"]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority")))))


def kept(found: Column) -> Column:
    """Detections that lie in no other one of the same or a higher priority.

    In the order of start, the longer first, then the higher priority, one lies in an
    earlier one if the furthest end before it, of its priority or higher, is not before its
    own. Of equal places with equal priority the first label stays.
    """
    order = F.array_sort(F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), (-s["priority"]).alias("low"), s["label"].alias("label"))))

    def apart(rows: Column) -> Column:
        def furthest(priority: int) -> Column:
            own = F.transform(rows, lambda s: F.when(-s["low"] >= priority, -s["back"]).otherwise(-1))
            return let(own, lambda ends: before(ends, -1, F.greatest))

        def by_priority(ends: Column) -> Column:
            stays = F.transform(rows, lambda s, i: F.struct(
                s["start"].alias("start"), (-s["back"]).alias("end"), s["label"].alias("label"), (-s["low"]).alias("priority"),
                (F.get(F.get(ends, -s["low"] - 1), i) < -s["back"]).alias("stays")))
            return F.transform(F.filter(stays, lambda s: s["stays"]), lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["priority"].alias("priority")))

        return let(F.array(*[furthest(p) for p in range(1, 6)]), by_priority)

    return let(order, lambda rows: F.when(F.size(rows) > 0, apart(rows)).otherwise(F.array().cast(f"array<{_SPAN}>")))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, places, found, score`` for every row of ``docs``; no shuffle.

    ``places`` are those of the fixed phrases, ``found`` the detections that stay. The
    score is that of the strongest evidence: its priority in fifths, a fixed phrase
    counting 3. A null text counts as empty; a very long one takes time in proportion to its
    length and matches. An empty table gives no rows.
    """
    body = text_or_empty(text)
    rows = docs.select(quoted(key).alias("_key"), body.alias("_text"))
    raw = F.col("_text")
    places_none = F.array().cast("array<struct<at:bigint,label:string>>")
    words = F.regexp_extract_all(lower_ascii(raw), F.lit(_WORD), F.lit(0))
    rows = rows.select(
        "_key", F.regexp_count(raw, F.lit(_CASED_WORD)).cast("long").alias("n_words"),
        F.when(raw.rlike(_PHRASE_GATE), phrase_places(words)).otherwise(places_none).alias("places"),
        F.when(raw.rlike(_ANCHOR_GATE), kept(detections(lower_ascii(raw))))
        .otherwise(F.array().cast(f"array<{_SPAN}>")).alias("found"))
    best = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda s: s["priority"])), F.lit(0)),
                      F.when(F.size("places") > 0, 3).otherwise(0))
    return rows.select(F.col("_key").alias(key), "n_words", "places", "found", (best / 5.0).alias("score"))


def _labels(*of: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*of))), ",")


def op3_license_scans(spark, sf_dir):
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("found", lambda s: s["label"])
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["at"].alias("first_word"), F.try_element_at("places", F.lit(-1))["at"].alias("last_word"),
        _labels(base).alias("base_labels"), _labels(base, own).alias("labels"), "score")
