"""Ordered license signatures. A space in a pattern stands for any run of characters between words.

Each license: label, keyword (a literal part of every match of its name patterns, lower case), name patterns, and
patterns of its addresses. From each come a rule for its SPDX tag, one for each address and one for each name.
"""

from __future__ import annotations

from typing import NamedTuple

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EDGE = r"(?:[0-9a-z]|[^\x00-\x7F])"

#: Levels, best first, and what a detection of each is worth in the score.
TAG, ADDRESS, NAME, PHRASE, NOTICE = range(5)
WORTH = {TAG: 0.95, ADDRESS: 0.85, NAME: 0.8, PHRASE: 0.7, NOTICE: 0.3}

VERSION = r"(?: version| v)? ?"

LICENSES: list[tuple[str, str, list[str], list[str]]] = [
    ("agpl-1.0", "affero", [r"affero general public license" + VERSION + "1"], [r"affero\.org/oagpl"]),
    ("agpl-3.0", "affero", [r"gnu affero general public license" + VERSION + "3"], [r"gnu\.org/licenses/agpl"]),
    ("gpl-1.0", "general public license", [r"gnu general public license" + VERSION + r"1(?!\d)", r"general public license as published by the free software foundation either version 1"], [r"gnu\.org/licenses/old licenses/gpl 1"]),
    ("gpl-2.0", "general public license", [r"gnu general public license" + VERSION + r"2(?!\d)", r"general public license as published by the free software foundation either version 2"], [r"gnu\.org/licenses/old licenses/gpl 2", r"gnu\.org/licenses/gpl 2"]),
    ("gpl-3.0", "general public license", [r"gnu general public license" + VERSION + r"3(?!\d)", r"general public license as published by the free software foundation either version 3"], [r"gnu\.org/licenses/gpl 3", r"opensource\.org/licenses/gpl 3"]),
    ("lgpl-2.0", "general public license", [r"gnu library general public license" + VERSION + "2"], [r"gnu\.org/licenses/old licenses/lgpl 2 0"]),
    ("lgpl-2.1", "general public license", [r"gnu lesser general public license" + VERSION + "2 1", r"lesser general public license as published by the free software foundation either version 2"], [r"gnu\.org/licenses/old licenses/lgpl 2 1"]),
    ("lgpl-3.0", "general public license", [r"gnu lesser general public license" + VERSION + "3", r"lesser general public license as published by the free software foundation either version 3"], [r"gnu\.org/licenses/lgpl"]),
    ("gfdl-1.1", "free documentation", [r"gnu free documentation license" + VERSION + "1 1"], [r"gnu\.org/licenses/old licenses/fdl 1 1"]),
    ("gfdl-1.2", "free documentation", [r"gnu free documentation license" + VERSION + "1 2"], [r"gnu\.org/licenses/old licenses/fdl 1 2"]),
    ("gfdl-1.3", "free documentation", [r"gnu free documentation license" + VERSION + "1 3"], [r"gnu\.org/licenses/fdl"]),
    ("apache-1.0", "apache", [r"apache (?:software )?license" + VERSION + r"1 0"], [r"apache\.org/licenses/license 1 0"]),
    ("apache-1.1", "apache", [r"apache (?:software )?license" + VERSION + r"1 1"], [r"apache\.org/licenses/license 1 1"]),
    ("apache-2.0", "apache", [r"apache (?:software )?license" + VERSION + r"2(?: 0)?(?!\d)", r"you may not use this file except in compliance with the apache license"], [r"apache\.org/licenses/license 2 0"]),
    ("mit", "mit", [r"(?:released|licensed|distributed) under the mit license", r"the mit license(?: mit)?", r"mit license mit"], [r"opensource\.org/licenses?/mit(?!-)", r"mit license\.org"]),
    ("mit-0", "mit", [r"mit no attribution"], [r"opensource\.org/licenses?/mit 0"]),
    ("x11", "x11", [r"x11 license"], [r"xfree86\.org/3\.3\.6/copyright"]),
    ("isc", "isc", [r"isc license", r"internet systems consortium license"], [r"opensource\.org/licenses?/isc"]),
    ("bsd-1-clause", "bsd", [r"(?:1|one) clause bsd license", r"bsd (?:1|one) clause"], [r"opensource\.org/licenses?/bsd 1"]),
    ("bsd-2-clause", "bsd", [r"(?:2|two) clause bsd license", r"bsd (?:2|two) clause", r"simplified bsd license", r"freebsd license"], [r"opensource\.org/licenses?/bsd 2"]),
    ("bsd-3-clause", "bsd", [r"(?:3|three) clause bsd license", r"bsd (?:3|three) clause", r"(?:new|modified|revised) bsd license"], [r"opensource\.org/licenses?/bsd 3"]),
    ("bsd-4-clause", "bsd", [r"(?:4|four) clause bsd license", r"bsd (?:4|four) clause", r"original bsd license"], [r"spdx\.org/licenses/bsd 4"]),
    ("0bsd", "bsd", [r"zero clause bsd", r"bsd zero clause license", r"bsd 0 clause"], [r"opensource\.org/licenses?/0bsd"]),
    ("mpl-1.0", "mozilla", [r"mozilla public license" + VERSION + "1 0"], [r"mozilla\.org/mpl/1 0"]),
    ("mpl-1.1", "mozilla", [r"mozilla public license" + VERSION + "1 1"], [r"mozilla\.org/mpl/1 1"]),
    ("mpl-2.0", "mozilla", [r"mozilla public license" + VERSION + r"2(?: 0)?"], [r"mozilla\.org/mpl/2 0", r"mozilla\.org/en us/mpl/2"]),
    ("epl-1.0", "eclipse", [r"eclipse public license" + VERSION + "1 0"], [r"eclipse\.org/legal/epl v10"]),
    ("epl-2.0", "eclipse", [r"eclipse public license" + VERSION + r"2(?: 0)?"], [r"eclipse\.org/legal/epl (?:v20|2 0)"]),
    ("edl-1.0", "eclipse", [r"eclipse distribution license" + VERSION + "1"], [r"eclipse\.org/org/documents/edl v10"]),
    ("cddl-1.0", "development and distribution", [r"common development and distribution license" + VERSION + r"1 0"], [r"opensource\.org/licenses?/cddl"]),
    ("cddl-1.1", "development and distribution", [r"common development and distribution license" + VERSION + r"1 1"], [r"glassfish\.java\.net/public/cddl"]),
    ("cpl-1.0", "common public", [r"common public license" + VERSION + r"1(?: 0)?"], [r"opensource\.org/licenses?/cpl1"]),
    ("ipl-1.0", "ibm", [r"ibm public license"], [r"opensource\.org/licenses?/ipl"]),
    ("eupl-1.1", "european union", [r"european union public licen[cs]e" + VERSION + r"1 1"], [r"joinup\.ec\.europa\.eu/software/page/eupl"]),
    ("eupl-1.2", "european union", [r"european union public licen[cs]e" + VERSION + r"1 2"], [r"joinup\.ec\.europa\.eu/collection/eupl"]),
    ("cecill-2.1", "cecill", [r"cecill free software license(?: agreement)?", r"cecill license"], [r"cecill\.info/licences/licence cecill v2"]),
    ("cecill-b", "cecill", [r"cecill b(?: free software)? license"], [r"cecill\.info/licences/licence cecill b"]),
    ("cecill-c", "cecill", [r"cecill c(?: free software)? license"], [r"cecill\.info/licences/licence cecill c"]),
    ("artistic-1.0", "artistic", [r"artistic license" + VERSION + "1"], [r"opensource\.org/licenses?/artistic 1"]),
    ("artistic-2.0", "artistic", [r"artistic license" + VERSION + "2"], [r"opensource\.org/licenses?/artistic 2"]),
    ("bsl-1.0", "boost", [r"boost software license(?:" + VERSION + r"1(?: 0)?)?"], [r"boost\.org/license"]),
    ("busl-1.1", "business source", [r"business source license(?:" + VERSION + r"1 1)?"], [r"mariadb\.com/bsl11"]),
    ("sspl-1.0", "server side", [r"server side public license"], [r"mongodb\.com/licensing/server side public license"]),
    ("elastic-2.0", "elastic", [r"elastic license(?:" + VERSION + r"2(?: 0)?)?"], [r"elastic\.co/licensing/elastic license"]),
    ("zlib", "zlib", [r"zlib license", r"zlib libpng license"], [r"zlib\.net/zlib license", r"opensource\.org/licenses?/zlib"]),
    ("libpng", "libpng", [r"libpng license", r"png reference library license"], [r"libpng\.org/pub/png/src/libpng license"]),
    ("wtfpl", "want to public", [r"do what the \S+ you want to public license"], [r"wtfpl\.net"]),
    ("unlicense", "unlicense", [r"the unlicense"], [r"unlicense\.org"]),
    ("cc0-1.0", "cc0", [r"cc0(?: 1 0)?(?: universal)?"], [r"creativecommons\.org/publicdomain/zero/1 0"]),
    ("pddl-1.0", "public domain", [r"public domain dedication and license"], [r"opendatacommons\.org/licenses/pddl"]),
    ("odbl-1.0", "open database", [r"open database license"], [r"opendatacommons\.org/licenses/odbl"]),
    ("odc-by-1.0", "open data commons", [r"open data commons attribution license"], [r"opendatacommons\.org/licenses/by"]),
    ("cc-by-2.0", "attribution", [r"creative commons attribution 2 0"], [r"creativecommons\.org/licenses/by/2 0"]),
    ("cc-by-3.0", "attribution", [r"creative commons attribution 3 0"], [r"creativecommons\.org/licenses/by/3 0"]),
    ("cc-by-4.0", "attribution", [r"creative commons attribution 4 0"], [r"creativecommons\.org/licenses/by/4 0"]),
    ("cc-by-sa-2.0", "share", [r"creative commons attribution share ?alike 2 0"], [r"creativecommons\.org/licenses/by sa/2"]),
    ("cc-by-sa-3.0", "share", [r"creative commons attribution share ?alike 3 0"], [r"creativecommons\.org/licenses/by sa/3"]),
    ("cc-by-sa-4.0", "share", [r"creative commons attribution share ?alike 4 0"], [r"creativecommons\.org/licenses/by sa/4"]),
    ("cc-by-nd-4.0", "deriv", [r"creative commons attribution no ?derivatives 4 0"], [r"creativecommons\.org/licenses/by nd/4"]),
    ("cc-by-nc-3.0", "commercial", [r"creative commons attribution non ?commercial 3 0"], [r"creativecommons\.org/licenses/by nc/3"]),
    ("cc-by-nc-4.0", "commercial", [r"creative commons attribution non ?commercial 4 0"], [r"creativecommons\.org/licenses/by nc/4"]),
    ("cc-by-nc-sa-3.0", "commercial", [r"creative commons attribution non ?commercial share ?alike 3 0"], [r"creativecommons\.org/licenses/by nc sa/3"]),
    ("cc-by-nc-sa-4.0", "commercial", [r"creative commons attribution non ?commercial share ?alike 4 0"], [r"creativecommons\.org/licenses/by nc sa/4"]),
    ("cc-by-nc-nd-4.0", "commercial", [r"creative commons attribution non ?commercial no ?derivatives 4 0"], [r"creativecommons\.org/licenses/by nc nd/4"]),
    ("ofl-1.1", "font", [r"sil open font license(?:" + VERSION + r"1 1)?"], [r"scripts\.sil\.org/ofl", r"openfontlicense\.org"]),
    ("python-2.0", "python", [r"python software foundation license", r"psf license agreement"], [r"python\.org/psf/license", r"docs\.python\.org/3/license"]),
    ("php-3.01", "php", [r"php license(?:" + VERSION + r"3 01)?"], [r"php\.net/license/3 01"]),
    ("ruby", "ruby", [r"ruby license"], [r"ruby lang\.org/en/about/license"]),
    ("perl", "perl", [r"under the same terms as perl itself license"], [r"dev\.perl\.org/licenses"]),
    ("tcl", "tcl", [r"tcl tk license", r"tcl license"], [r"tcl\.tk/software/tcltk/license"]),
    ("postgresql", "postgresql", [r"postgresql licen[cs]e"], [r"opensource\.org/licenses?/postgresql"]),
    ("ncsa", "ncsa", [r"university of illinois ncsa open source license", r"ncsa open source license"], [r"opensource\.org/licenses?/ncsa"]),
    ("upl-1.0", "universal permissive", [r"universal permissive license"], [r"oss\.oracle\.com/licenses/upl"]),
    ("ms-pl", "microsoft", [r"microsoft public license"], [r"opensource\.org/licenses?/ms pl"]),
    ("ms-rl", "microsoft", [r"microsoft reciprocal license"], [r"opensource\.org/licenses?/ms rl"]),
    ("osl-3.0", "open software", [r"open software license(?:" + VERSION + r"3(?: 0)?)?"], [r"opensource\.org/licenses?/osl 3"]),
    ("afl-3.0", "academic free", [r"academic free license(?:" + VERSION + r"3(?: 0)?)?"], [r"opensource\.org/licenses?/afl 3"]),
    ("ecl-2.0", "educational community", [r"educational community license(?:" + VERSION + r"2(?: 0)?)?"], [r"opensource\.org/licenses?/ecl 2"]),
    ("apsl-2.0", "apple", [r"apple public source license"], [r"opensource\.apple\.com/license/apsl"]),
    ("sgi-b-2.0", "sgi", [r"sgi free software license b"], [r"sgi\.com/projects/freeb"]),
    ("vim", "vim", [r"vim license"], [r"vimhelp\.org/uganda"]),
    ("beerware", "beer", [r"beer ware license", r"beerware license"], [r"people\.freebsd\.org/~phk"]),
    ("rail-m", "rail", [r"openrail m license", r"open rail license"], [r"bigscience\.huggingface\.co/blog/bigscience openrail"]),
    ("gust-lppl", "latex", [r"latex project public license"], [r"latex project\.org/lppl"]),
    ("ogl-uk-3.0", "open government", [r"open government licen[cs]e(?:" + VERSION + r"3(?: 0)?)?"], [r"nationalarchives\.gov\.uk/doc/open government licence"]),
    ("etalab-2.0", "licence ouverte", [r"licence ouverte(?:" + VERSION + r"2(?: 0)?)?"], [r"etalab\.gouv\.fr/licence ouverte"]),
    ("dl-de-by-2.0", "datenlizenz", [r"datenlizenz deutschland namensnennung"], [r"govdata\.de/dl de/by"]),
    ("commercial", "licen", [r"end user licen[cs]e agreement", r"proprietary licen[cs]e"], []),
]

#: The phrases that are always counted, with their labels.
BASE = [("gpl", "general public license", "gnu general public license"), ("apache", "apache", "apache license"), ("cc-by", "cc", "cc by"), ("mit", "mit", "mit license")]

#: Forms of "cc by" with further terms, then plain notices that name no license.
FORMS = [
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: \d \d)?", NAME), ("cc-by-nc-sa", "cc", r"cc by nc sa(?: \d \d)?", NAME), ("cc-by-nc", "cc", r"cc by nc(?! (?:sa|nd))(?: \d \d)?", NAME),
    ("cc-by-nd", "cc", r"cc by nd(?: \d \d)?", NAME), ("cc-by-sa", "cc", r"cc by sa(?: \d \d)?", NAME), ("cc-by-4.0", "cc", r"cc by 4 0", NAME), ("cc-by-3.0", "cc", r"cc by 3 0", NAME),
    ("public-domain", "public domain", r"(?:dedicated to|in|released into) the public domain", NOTICE), ("copyright", "all rights reserved", r"all rights reserved", NOTICE),
    ("license-notice", "licensed under", r"licensed under(?: the)?", NOTICE), ("license-notice", "licence", r"(?:released|published) under (?:the|an?) (?:open )?licence", NOTICE),
]

class Rule(NamedTuple):
    rule: int  # place in the order
    label: str
    level: int
    keyword: str
    pattern: str
    base_words: int  # words of a base phrase; 0 for the method's own rules


def _pattern(p: str) -> str:
    """Spaces become gaps; an optional group or a character class may follow one."""
    p = p.replace(" ?", "\0").replace(" ", GAP).replace("\0", f"(?:{GAP})?")
    return f"(?<!{EDGE}){p}(?!{EDGE})"


def rules() -> list[Rule]:
    """All rules in order: tags, addresses, names, base phrases, notices. Every match of a rule holds its keyword."""
    found: list[tuple[str, int, str, str, int]] = []
    for label, _, _, _ in LICENSES:
        found.append((label, TAG, "spdx", rf"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}(?: only| or later)?", 0))
    for label, _, _, urls in LICENSES:
        found += [(label, ADDRESS, u.split("/")[0].split(" ")[0].replace("\\", ""), u, 0) for u in urls]
    for label, key, names, _ in LICENSES:
        found += [(label, NAME, key.split(" ")[0] if key.split(" ")[0] in n else "licen", n, 0) for n in names]
    found += [(label, level, key.split(" ")[0], p, 0) for label, key, p, level in FORMS if level == NAME]
    found += [(label, PHRASE, key.split(" ")[0], p, len(p.split())) for label, key, p in BASE]
    found += [(label, level, key.split(" ")[0], p, 0) for label, key, p, level in FORMS if level == NOTICE]
    return [Rule(i, label, level, key, _pattern(p), n) for i, (label, level, key, p, n) in enumerate(found)]


def anchors() -> list[str]:
    """A few rare literals, at least one of which is in every match of any rule; every rule of keyword "cc" begins "cc by"."""
    rare = ("licen", "reserved", "attribution", "clause", "domain", "cc0")
    literal = lambda r: r.pattern.replace("\\", "")
    return sorted({next((x for x in rare if x in literal(r)), r.keyword) for r in rules()})
