"""Signature rules for licences, over lower-case words joined by single spaces.

Notices and clauses are written out in license_texts; the tables here make the rules for licences that a text
only names, by family, version and spelling. Each rule is (priority, label, keyword, pattern): `pattern` is a regular expression in which the
keyword, marked by @, stands once; it is only tried where that word occurs. Punctuation is gone by
then: "CC BY-NC 4.0" is "cc by nc 4 0". A higher priority is a more exact reading.
"""

from __future__ import annotations

import re

from .license_texts import wording

UNDER = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered) (?:for use )?under (?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?"
OR_LATER = r"(?: or (?:later|newer|any later version|at your option any later version))?"
LICENCE = r"licen[sc]e"

#: name, its words, versions (major minor), words of the short name
FAMILIES: list[tuple[str, str, list[str], str]] = [
    ("gpl", "gnu general public", ["1 0", "2 0", "3 0"], "gpl"),
    ("lgpl", "gnu (?:lesser|library) general public", ["2 0", "2 1", "3 0"], "lgpl"),
    ("agpl", "(?:gnu )?affero general public", ["1 0", "3 0"], "agpl"),
    ("gfdl", "gnu free documentation", ["1 1", "1 2", "1 3"], "gfdl"),
    ("apache", "apache(?: software)?", ["1 0", "1 1", "2 0"], "apache"),
    ("mpl", "mozilla public", ["1 0", "1 1", "2 0"], "mpl"),
    ("epl", "eclipse public", ["1 0", "2 0"], "epl"),
    ("cddl", "common development and distribution", ["1 0", "1 1"], "cddl"),
    ("cpl", "common public", ["1 0"], "cpl"),
    ("ipl", "ibm public", ["1 0"], "ipl"),
    ("artistic", "(?:perl )?artistic", ["1 0", "2 0"], "artistic"),
    ("eupl", "european union public", ["1 0", "1 1", "1 2"], "eupl"),
    ("osl", "open software", ["1 0", "2 0", "2 1", "3 0"], "osl"),
    ("afl", "academic free", ["1 1", "1 2", "2 0", "2 1", "3 0"], "afl"),
    ("odbl", "open database", ["1 0"], "odbl"),
    ("ofl", "sil open font", ["1 0", "1 1"], "ofl"),
    ("bsl", "boost software", ["1 0"], "bsl"),
    ("busl", "business source", ["1 1"], "busl"),
    ("sspl", "server side public", ["1 0"], "sspl"),
    ("elastic", "elastic", ["1 0", "2 0"], "elastic"),
    ("cecill", "cecill free software", ["1 0", "1 1", "2 0", "2 1"], "cecill"),
    ("lppl", "latex project public", ["1 0", "1 1", "1 2", "1 3"], "lppl"),
    ("psf", "python software foundation", ["2 0"], "psf"),
    ("php", "php", ["3 0", "3 01"], "php"),
    ("zpl", "zope public", ["1 1", "2 0", "2 1"], "zpl"),
    ("apsl", "apple public source", ["1 0", "1 1", "1 2", "2 0"], "apsl"),
    ("qpl", "q public", ["1 0"], "qpl"),
    ("rpl", "reciprocal public", ["1 1", "1 5"], "rpl"),
    ("npl", "netscape public", ["1 0", "1 1"], "npl"),
    ("spl", "sun public", ["1 0"], "spl"),
    ("ecl", "educational community", ["1 0", "2 0"], "ecl"),
    ("upl", "universal permissive", ["1 0"], "upl"),
    ("mulan", "mulan permissive software", ["1 0", "2 0"], "mulanpsl"),
    ("ms-pl", "microsoft public", [], "mspl"),
    ("ms-rl", "microsoft reciprocal", [], "msrl"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict)", ["1 0 0"], "polyform"),
    ("openrail", "(?:creativeml )?open ?rail(?: m)?", [], "openrail"),
]
#: name, its words before "license"
PLAIN: list[tuple[str, str]] = [
    ("mit", "(?:the )?mit"), ("mit", "expat"), ("mit", "mit x11"), ("x11", "x11"), ("isc", "isc"), ("zlib", "zlib(?: libpng)?"),
    ("bsd-0-clause", "(?:0|zero) clause bsd"), ("bsd-2-clause", "(?:2|two) clause bsd"), ("bsd-2-clause", "simplified bsd"), ("bsd-2-clause", "freebsd"),
    ("bsd-3-clause", "(?:3|three) clause bsd"), ("bsd-3-clause", "(?:new|modified|revised) bsd"), ("bsd-4-clause", "(?:4|four) clause bsd"), ("bsd-4-clause", "original bsd"), ("bsd", "bsd(?: style)?"),
    ("ncsa", "university of illinois ncsa open source"), ("openssl", "openssl"), ("postgresql", "postgresql"), ("ruby", "ruby"), ("vim", "vim"), ("json", "json"), ("beerware", "beer ?ware"),
    ("sleepycat", "sleepycat"), ("watcom", "(?:sybase )?open watcom public"), ("unicode", "unicode"), ("curl", "curl"), ("ntp", "ntp"), ("w3c", "w3c software"), ("icu", "icu"), ("ftl", "freetype project"),
    ("intel", "intel open source"), ("nokia", "nokia open source"), ("cua", "cua office public"), ("entessa", "entessa public"), ("motosoto", "motosoto open source"), ("naumen", "naumen public"), ("nasa", "nasa open source"),
    ("libpng", "libpng"), ("imagemagick", "imagemagick"), ("info-zip", "info zip"), ("wtfpl", "do what the fuck you want to public"), ("community", "llama (?:2|3) community"), ("odc-by", "open data commons attribution"), ("pddl", "public domain dedication and"),
]
CC_KINDS: list[tuple[str, str, str]] = [
    ("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: priority, label, keyword, pattern
PHRASES: list[tuple[int, str, str, str]] = [
    (60, "bsd", "redistribution", r"@redistribution and use in source and binary forms"),
    (60, "unlicense", "unencumbered", r"free and @unencumbered software released into the public domain"),
    (60, "unlicense", "unlicense", r"(?:the )?@unlicense"),
    (50, "public-domain", "domain", r"(?:released|dedicated|placed) (?:in|into|to) the public @domain"),
    (20, "public-domain", "domain", r"public @domain"),
    (50, "proprietary", "reserved", r"all rights @reserved"),
    (50, "proprietary", "proprietary", r"confidential and @proprietary"),
    (50, "proprietary", "proprietary", r"@proprietary (?:and confidential|licen[sc]e|software)"),
    (50, "wtfpl", "wtfpl", r"(?:the )?@wtfpl"),
    (50, "cc0", "cc0", r"@cc0(?: 1 0)?(?: universal)?"),
    (50, "cc0", "commons", r"creative @commons (?:zero|cc0|public domain dedication)"),
    (20, "creative-commons", "commons", r"creative @commons"),
    (50, "commons-clause", "commons", r"@commons clause"),
    (10, "free-software", "software", r"this program is free @software"),
    (10, "open-source", "source", r"open @source licen[sc]e"),
]


def rules() -> list[tuple[int, str, str, str]]:
    """All rules: the wording of notices and clauses, and names from the tables above."""
    out = [*wording(), *PHRASES]
    for word in ("license", "licence"):
        for label, words, versions, short in FAMILIES:
            out.append((30, label, word, rf"(?:the )?{words} @{word}"))
            out.append((35, label, word, rf"{UNDER}{words} @{word}"))
            for v in versions:
                dotted = v.replace(" ", ".")
                tail = v if not v.endswith(" 0") else f"{v[:-2]}(?: 0)?"
                out.append((45, f"{label}-{dotted}", word, rf"(?:the )?{words} @{word} (?:version |v )?v?{tail}{OR_LATER}"))
                out.append((46, f"{label}-{dotted}", word, rf"{UNDER}{words} @{word} (?:version |v )?v?{tail}{OR_LATER}"))
        for label, words in PLAIN:
            out.append((30, label, word, rf"{words} @{word}"))
            out.append((35, label, word, rf"{UNDER}{words} @{word}"))
    for label, words, versions, short in FAMILIES:
        head, _, rest = short.partition(" ")
        rest = f" {rest}" if rest else ""
        for v in versions:
            tail = v if not v.endswith(" 0") else f"{v[:-2]}(?: 0)?"
            out.append((40, f"{label}-{v.replace(' ', '.')}", head, rf"(?:spdx licen[sc]e identifier )?@{head}{rest} (?:version |v )?v?{tail}(?: only| or later)?"))
        out.append((42, label, head, rf"spdx licen[sc]e identifier @{head}{rest}"))
    for label, short, long in CC_KINDS:
        out.append((20, label, "cc", rf"@cc {short}"))
        out.append((25, label, "cc", rf"{UNDER}@cc {short}(?: licen[sc]e)?"))
        out.append((26, label, "commons", rf"creative @commons {long}"))
        for v in CC_VERSIONS:
            out.append((40, f"{label}-{v.replace(' ', '.')}", "cc", rf"(?:{UNDER})?@cc {short} {v}(?: international| unported)?(?: licen[sc]e)?"))
            out.append((40, f"{label}-{v.replace(' ', '.')}", "commons", rf"(?:{UNDER})?creative @commons {long} {v}(?: international| unported)?(?: licen[sc]e)?"))
    for label in ("mit", "isc", "zlib", "bsd 2 clause", "bsd 3 clause", "0bsd"):
        head, _, rest = label.partition(" ")
        out.append((42, label.replace(" ", "-"), "identifier", rf"spdx licen[sc]e @identifier {label}"))
    return out


def needed_word(keyword: str, pattern: str) -> str:
    """A literal word that every match of the pattern holds: the longest outside its groups, which
    lets most rules be passed over without trying them."""
    while (flat := re.sub(r"\((?:\?:)?[^()]*\)\??", " ", pattern)) != pattern:
        pattern = flat
    pattern = re.sub(r"\[[^\]]*\]|\\.|.\?", " ", pattern)
    return max((w for w in re.findall(r"(?<![a-z0-9@])[a-z0-9]+(?![a-z0-9])", pattern)), key=len, default=keyword)
