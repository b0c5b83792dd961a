"""License scan by ordered signature rules (DataFrame expressions only).

Text is reduced to words joined by single spaces, so that every rule is a regex
over words.  A document is examined only if a gate keyword occurs in it, and a
rule only if its own keyword does.  Each rule yields the intervals it matches;
intervals that lie within another one are suppressed (of equal intervals the
earlier rule wins), and the labels of the surviving intervals are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases every result counts, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_V = r"(?: version| ver| v)?"
_LATER = r"(?: or(?: at your option)?(?: any)? later(?: version)?| only)?"

#: (label, whole word every match of the family contains, regexes in order of priority).
#: Regexes are written over lower-case words separated by single spaces.
FAMILIES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("agpl-3.0", "affero", (
        rf"gnu affero general public license{_V} 3(?: 0)?{_LATER}", rf"affero general public license{_V} 3(?: 0)?",
        r"gnu affero general public license as published by the free software foundation",
        r"gnu affero general public license", r"affero gpl")),
    ("agpl-3.0", "agpl", (r"spdx license identifier agpl 3 0(?: only| or later)?", r"agpl(?: v ?| )3(?: 0)?(?: only| or later)?")),
    ("agpl-3.0", "agpl3", (r"agpl3(?: 0)?(?: only| or later)?",)),
    ("agpl-3.0", "agplv3", (r"agplv3",)),
    ("agpl-3.0", "agpl", (r"gnu agpl", r"agpl license")),
    ("lgpl-3.0", "lesser", (
        rf"gnu lesser general public license{_V} 3(?: 0)?{_LATER}", rf"lesser general public license{_V} 3(?: 0)?{_LATER}")),
    ("lgpl-2.1", "lesser", (
        rf"gnu lesser general public license{_V} 2 1{_LATER}", rf"lesser general public license{_V} 2 1{_LATER}")),
    ("lgpl", "lesser", (
        r"gnu lesser general public license as published by the free software foundation",
        r"gnu lesser general public license", r"lesser general public license", r"gnu lesser gpl", r"lesser gpl")),
    ("lgpl-2.0", "library", (
        rf"gnu library general public license{_V} 2(?: 0)?{_LATER}", r"gnu library general public license", r"library general public license")),
    ("lgpl", "lgpl", (r"spdx license identifier lgpl [23] [01](?: only| or later)?", r"lgpl(?: v ?| )3(?: 0)?")),
    ("lgpl", "lgpl3", (r"lgpl3(?: 0)?",)),
    ("lgpl", "lgpl", (r"lgpl(?: v ?| )2 1",)),
    ("lgpl", "lgpl2", (r"lgpl2 1",)),
    ("lgpl", "lgpl", (r"gnu lgpl", r"lgpl license")),
    ("lgpl-3.0", "lgplv3", (r"gnu lgplv3", r"lgplv3")),
    ("gpl-3.0", "gnu", (
        rf"gnu general public license{_V} 3(?: 0)?{_LATER}", r"gnu gpl(?: version| v)? 3(?: 0)?", r"gnu gplv3",
        r"gnu general public license as published by the free software foundation either version 3")),
    ("gpl-2.0", "gnu", (
        rf"gnu general public license{_V} 2(?: 0)?{_LATER}", r"gnu gpl(?: version| v)? 2(?: 0)?", r"gnu gplv2",
        r"gnu general public license as published by the free software foundation either version 2",
        r"gnu general public license with classpath exception")),
    ("gpl-1.0", "gnu", (rf"gnu general public license{_V} 1(?: 0)?{_LATER}", r"gnu gpl(?: version| v)? 1(?: 0)?")),
    ("gpl", "gnu", (
        r"under the terms of the gnu general public license", r"gnu general public license as published by the free software foundation",
        r"gnu public license", r"gnu copyleft", r"gnu gpl")),
    ("gfdl", "gnu", (rf"gnu free documentation license{_V} 1 [123]{_LATER}", r"gnu free documentation license", r"gnu fdl", r"gnu gfdl")),
    ("gfdl", "gfdl", (r"spdx license identifier gfdl 1 [123]", r"gfdl(?: version)? 1 [123]", r"gfdl license")),
    ("gpl-3.0", "gpl", (r"spdx license identifier gpl 3 0(?: only| or later)?", r"gpl(?: version| v)? 3(?: 0)?(?: only| or later)?", r"licensed under the gpl version 3")),
    ("gpl-2.0", "gpl", (r"spdx license identifier gpl 2 0(?: only| or later)?", r"gpl(?: version| v)? 2(?: 0)?(?: only| or later)?", r"licensed under the gpl version 2")),
    ("gpl", "gpl", (r"licensed under (?:the )?gpl", r"released under (?:the )?gpl", r"gpl licen[sc]ed?", r"terms of the gpl", r"dual licensed (?:mit|bsd)(?: and| or)? gpl")),
    ("gpl-3.0", "gplv3", (r"licensed under (?:the )?gplv3", r"gplv3(?: or later)?")),
    ("gpl-2.0", "gplv2", (r"licensed under (?:the )?gplv2", r"gplv2(?: or later)?")),
    ("apache-2.0", "apache", (
        r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        rf"apache(?: software)? license{_V} 2(?: 0)?", r"apache 2(?: 0)? license", r"spdx license identifier apache 2 0",
        r"(?:www )?apache org licenses license 2 0", r"apache 2 0")),
    ("apache-2.0", "apl", (r"apl 2 0",)),
    ("apache-2.0", "asl", (r"asl 2 0",)),
    ("apache-1.1", "apache", (rf"apache(?: software)? license{_V} 1 1", r"spdx license identifier apache 1 1", r"apache 1 1 license")),
    ("apache-1.0", "apache", (rf"apache(?: software)? license{_V} 1 0", r"spdx license identifier apache 1 0", r"apache 1 0 license")),
    ("apache", "apache", (r"apache software license", r"apache public license", r"apache style license", r"apache licensed", r"apache software foundation license")),
    ("cc-by-nc-nd", "nd", (r"cc by nc nd(?: version)? [1234] 0", r"cc by nc nd")),
    ("cc-by-nc-nd", "attribution", (r"creative commons attribution non ?commercial no ?deriv(?:ative|ative works|s|atives)",)),
    ("cc-by-nc-nd", "nd", (
        r"creativecommons org licenses by nc nd [1234] 0", r"creative commons by nc nd", r"spdx license identifier cc by nc nd [1234] 0")),
    ("cc-by-nc-sa", "sa", (
        r"cc by nc sa(?: version)? [1234] 0", r"cc by nc sa", r"creative commons by nc sa", r"creativecommons org licenses by nc sa [1234] 0",
        r"spdx license identifier cc by nc sa [1234] 0")),
    ("cc-by-nc-sa", "noncommercial", (r"creative commons attribution noncommercial share ?alike(?: [1234] 0)?", r"attribution noncommercial share ?alike [1234] 0")),
    ("cc-by-nc", "nc", (
        r"cc by nc(?: version)? [1234] 0", r"cc by nc", r"creative commons by nc", r"creativecommons org licenses by nc [1234] 0",
        r"spdx license identifier cc by nc [1234] 0")),
    ("cc-by-nc", "noncommercial", (r"creative commons attribution noncommercial(?: [1234] 0)?", r"attribution noncommercial [1234] 0")),
    ("cc-by-nd", "nd", (r"cc by nd(?: version)? [1234] 0", r"cc by nd", r"creative commons by nd", r"creativecommons org licenses by nd [1234] 0", r"spdx license identifier cc by nd [1234] 0")),
    ("cc-by-nd", "noderivatives", (r"creative commons attribution noderivatives(?: [1234] 0)?", r"attribution noderivatives [1234] 0")),
    ("cc-by-sa", "sa", (r"cc by sa(?: version)? [1234] 0", r"cc by sa", r"creative commons by sa", r"creativecommons org licenses by sa [1234] 0", r"spdx license identifier cc by sa [1234] 0")),
    ("cc-by-sa", "sharealike", (r"creative commons attribution sharealike(?: [1234] 0)?", r"attribution sharealike [1234] 0")),
    ("cc-by", "cc", (r"cc by(?: version)? [1234] 0", r"spdx license identifier cc by [1234] 0")),
    ("cc-by", "creativecommons", (r"creativecommons org licenses by [1234] 0",)),
    ("cc-by", "attribution", (r"creative commons attribution(?: international)?(?: public)?(?: license)?(?: [1234] 0)?", r"attribution [1234] 0 international")),
    ("cc0", "cc0", (r"spdx license identifier cc0 1 0", r"creative commons cc0(?: 1 0)?(?: universal)?", r"cc0 1 0(?: universal)?", r"cc0 license", r"under cc0")),
    ("cc0", "zero", (r"creative commons zero(?: v)?(?: 1 0)?(?: universal)?", r"creativecommons org publicdomain zero 1 0")),
    ("public-domain", "public", (
        r"released (?:in)?to the public domain", r"dedicated to the public domain", r"placed in the public domain", r"in the public domain", r"public domain dedication")),
    ("public-domain", "publicdomain", (r"creativecommons org publicdomain mark 1 0", r"publicdomain mark")),
    ("creative-commons", "commons", (r"creative commons public license", r"creative commons licen[cs]e", r"creative commons")),
    ("mit", "mit", (
        r"spdx license identifier mit", r"(?:released|licensed|distributed|available) under the(?: terms of the)? mit license", r"the mit license mit", r"mit license",
        r"opensource org licenses mit(?: license)?", r"mit licensed", r"mit style license", r"mit x11 license", r"dual licensed mit", r"expat mit license")),
    ("mit-0", "mit", (r"mit no attribution(?: license)?", r"spdx license identifier mit 0", r"mit 0 license")),
    ("mit", "expat", (r"expat license", r"license expat")),
    ("mit", "permission", (
        r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        r"permission is hereby granted free of charge to any person obtaining a copy")),
    ("isc", "isc", (r"spdx license identifier isc", r"isc license", r"licensed under (?:the )?isc", r"opensource org licenses isc(?: license)?", r"internet systems consortium isc license")),
    ("isc", "permission", (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("bsd-2-clause", "bsd", (r"spdx license identifier bsd 2 clause", r"bsd 2 clause(?: license)?", r"simplified bsd license", r"2 clause bsd", r"two clause bsd")),
    ("bsd-2-clause", "freebsd", (r"freebsd license",)),
    ("bsd-3-clause", "bsd", (r"spdx license identifier bsd 3 clause", r"bsd 3 clause(?: clear)?(?: license)?", r"new bsd license", r"revised bsd license", r"modified bsd license", r"3 clause bsd", r"three clause bsd")),
    ("bsd-4-clause", "bsd", (r"spdx license identifier bsd 4 clause", r"bsd 4 clause(?: license)?", r"original bsd license", r"4 clause bsd")),
    ("0bsd", "0bsd", (r"spdx license identifier 0bsd", r"0bsd license")),
    ("0bsd", "zero", (r"zero clause bsd",)),
    ("bsd", "bsd", (r"bsd style license", r"bsd licensed", r"bsd license")),
    ("bsd", "berkeley", (r"berkeley software distribution",)),
    ("bsd", "redistributions", (
        r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        r"redistributions in binary form must reproduce the above copyright notice")),
    ("bsd", "redistribution", (r"redistribution and use in source and binary forms with or without modification are permitted",)),
    ("mpl-2.0", "mozilla", (rf"mozilla public license{_V} 2(?: 0)?", r"mozilla org mpl 2 0", r"this source code form is subject to the terms of the mozilla public license v 2 0")),
    ("mpl-1.1", "mozilla", (rf"mozilla public license{_V} 1 1", r"mozilla org mpl 1 1", r"the contents of this file are subject to the mozilla public license version 1 1")),
    ("mpl", "mozilla", (r"mozilla public license", r"mozilla license")),
    ("mpl-2.0", "mpl", (r"spdx license identifier mpl 2 0", r"mpl 2 0", r"mpl version 2", r"licensed under (?:the )?mpl")),
    ("mpl-1.1", "mpl", (r"spdx license identifier mpl 1 1", r"mpl 1 1")),
    ("epl-2.0", "eclipse", (rf"eclipse public license{_V} 2(?: 0)?", r"eclipse org legal epl 2 0")),
    ("epl-1.0", "eclipse", (rf"eclipse public license{_V} 1(?: 0)?", r"eclipse org legal epl v10", r"eclipse public license")),
    ("edl-1.0", "eclipse", (rf"eclipse distribution license{_V} 1(?: 0)?", r"eclipse distribution license")),
    ("epl-2.0", "epl", (r"spdx license identifier epl 2 0", r"epl 2 0")),
    ("epl-1.0", "epl", (r"spdx license identifier epl 1 0", r"epl 1 0", r"epl license")),
    ("cddl-1.0", "cddl", (r"spdx license identifier cddl 1 0", r"cddl(?: version)? 1 0", r"cddl license")),
    ("cddl-1.1", "cddl", (r"spdx license identifier cddl 1 1", r"cddl(?: version)? 1 1")),
    ("cddl-1.0", "common", (rf"common development and distribution license{_V} 1 0", r"common development and distribution license")),
    ("cpl-1.0", "common", (rf"common public license{_V} 1 0", r"common public license")),
    ("cpal-1.0", "common", (rf"common public attribution license{_V} 1 0", r"common public attribution license")),
    ("eupl-1.2", "eupl", (r"spdx license identifier eupl 1 2", r"eupl(?: version| v)? 1 2")),
    ("eupl-1.1", "eupl", (r"spdx license identifier eupl 1 1", r"eupl(?: version| v)? 1 1", r"eupl licen[cs]e")),
    ("eupl-1.2", "european", (rf"european union public licen[cs]e{_V} 1 2", r"european union public licen[cs]e")),
    ("artistic-2.0", "artistic", (rf"artistic license{_V} 2(?: 0)?", r"spdx license identifier artistic 2 0", r"artistic 2 0 license")),
    ("artistic-1.0", "artistic", (rf"artistic license{_V} 1(?: 0)?", r"perl artistic license", r"artistic license", r"spdx license identifier artistic 1 0")),
    ("bsl-1.0", "boost", (rf"boost software license{_V} 1(?: 0)?", r"boost software license", r"boost org license 1 0(?: txt)?", r"boost license")),
    ("bsl-1.0", "bsl", (r"spdx license identifier bsl 1 0", r"bsl 1 0")),
    ("busl-1.1", "business", (rf"business source license{_V} 1 1", r"business source license")),
    ("busl-1.1", "busl", (r"spdx license identifier busl 1 1", r"busl 1 1")),
    ("sspl-1.0", "sspl", (r"spdx license identifier sspl 1 0", r"sspl(?: version| v)? 1(?: 0)?", r"sspl license")),
    ("sspl-1.0", "server", (rf"server side public license{_V} 1(?: 0)?", r"server side public license")),
    ("elastic-2.0", "elastic", (r"elastic license(?: version)? 2 0", r"spdx license identifier elastic 2 0", r"elastic license")),
    ("unlicense", "unlicense", (r"spdx license identifier unlicense", r"unlicense org", r"the unlicense", r"unlicense")),
    ("unlicense", "unencumbered", (r"this is free and unencumbered software released into the public domain",)),
    ("wtfpl", "wtfpl", (r"spdx license identifier wtfpl", r"wtfpl(?: version)? 2", r"wtfpl")),
    ("zlib", "zlib", (r"spdx license identifier zlib", r"zlib libpng license", r"zlib license", r"zlib style license")),
    ("zlib", "freely", (r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",)),
    ("libpng", "libpng", (r"spdx license identifier libpng 2 0", r"libpng license")),
    ("postgresql", "postgresql", (r"spdx license identifier postgresql", r"postgresql licen[cs]e")),
    ("python-2.0", "python", (rf"python software foundation license{_V} 2", r"python software foundation license", r"python license", r"spdx license identifier python 2 0")),
    ("psf-2.0", "psf", (r"spdx license identifier psf 2 0", r"psf license")),
    ("ruby", "ruby", (r"spdx license identifier ruby", r"ruby license", r"same terms as ruby")),
    ("perl", "perl", (r"same terms as perl(?: itself)?", r"perl license")),
    ("php-3.01", "php", (rf"php license{_V} 3 01", r"spdx license identifier php 3 01", r"php license")),
    ("ofl-1.1", "sil", (rf"sil open font license{_V} 1 1", r"sil open font license", r"scripts sil org ofl")),
    ("ofl-1.1", "ofl", (r"spdx license identifier ofl 1 1", r"ofl 1 1", r"ofl license")),
    ("odbl-1.0", "odbl", (r"spdx license identifier odbl 1 0", r"odbl(?: version)? 1 0", r"odbl license")),
    ("odbl-1.0", "database", (r"open data commons open database license", r"open database license(?: odbl)?(?: v1 0)?")),
    ("odc-by-1.0", "commons", (r"open data commons attribution license(?: v1 0)?",)),
    ("odc-by-1.0", "opendatacommons", (r"opendatacommons org licenses by",)),
    ("pddl-1.0", "pddl", (r"spdx license identifier pddl 1 0",)),
    ("pddl-1.0", "dedication", (r"open data commons public domain dedication and license(?: pddl)?",)),
    ("pddl-1.0", "pddl", (r"pddl license",)),
    ("ms-pl", "microsoft", (r"microsoft public license(?: ms pl)?", r"microsoft reciprocal license(?: ms rl)?", r"microsoft permissive license")),
    ("ms-pl", "ms", (r"spdx license identifier ms pl", r"ms pl license")),
    ("osl-3.0", "osl", (r"spdx license identifier osl 3 0", r"osl 3 0")),
    ("osl-3.0", "open", (rf"open software license{_V} 3(?: 0)?", r"open software license")),
    ("afl-3.0", "academic", (rf"academic free license{_V} 3 0", rf"academic free license{_V} 2 1", r"academic free license")),
    ("ecl-2.0", "educational", (rf"educational community license{_V} 2(?: 0)?", r"educational community license")),
    ("ncsa", "ncsa", (r"university of illinois ncsa open source license", r"spdx license identifier ncsa", r"ncsa license")),
    ("vim", "vim", (r"spdx license identifier vim", r"vim license")),
    ("curl", "curl", (r"spdx license identifier curl", r"curl license")),
    ("openssl", "openssl", (r"spdx license identifier openssl", r"openssl license", r"openssl and ssleay licenses")),
    ("w3c", "w3c", (r"w3c software notice and license", r"w3c software and document notice and license", r"w3c license", r"spdx license identifier w3c")),
    ("unicode", "unicode", (r"unicode license(?: v3| agreement)?", r"unicode inc license agreement data files and software", r"spdx license identifier unicode 3 0")),
    ("ipl-1.0", "ibm", (rf"ibm public license{_V} 1 0", r"ibm public license")),
    ("qpl-1.0", "q", (rf"q public license{_V} 1 0", r"q public license")),
    ("sleepycat", "sleepycat", (r"spdx license identifier sleepycat", r"sleepycat license")),
    ("latex-1.3c", "latex", (rf"latex project public license{_V} 1 3c?", r"latex project public license")),
    ("bittorrent", "bittorrent", (r"bittorrent open source license",)),
    ("beerware", "beerware", (r"spdx license identifier beerware", r"beerware license", r"the beerware license revision 42")),
    ("json", "evil", (r"the software shall be used for good not evil",)),
    ("mulan-2.0", "mulan", (r"mulan permissive software license(?: version)? 2", r"mulan psl v2")),
    ("mulan-2.0", "mulanpsl", (r"mulanpsl 2 0",)),
    ("openrail", "creativeml", (r"creativeml open ?rail m",)),
    ("openrail", "openrail", (r"bigscience openrail m", r"openrail m? ?license", r"openrail")),
    ("llama", "llama", (r"llama [234](?: [123])? community license(?: agreement)?", r"llama community license")),
    ("proprietary", "proprietary", (r"proprietary and confidential", r"proprietary license", r"confidential and proprietary")),
    ("all-rights-reserved", "rights", (r"all rights reserved",)),
    ("all-rights-reserved", "vorbehalten", (r"alle rechte vorbehalten",)),
    ("all-rights-reserved", "rights", (r"some rights reserved",)),
    ("copyright", "copyright", (r"copyright c (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", r"copyright (?:19|20)[0-9][0-9]", r"under copyright law")),
    ("other", "license", (r"licensed under the [^ ]+(?: [^ ]+){0,3} license", r"see the license file", r"license agreement", r"license terms", r"software license", r"open source license")),
    ("other", "licence", (r"released under the [^ ]+ licence", r"see the licence file", r"licence agreement", r"software licence")),
)

#: Without one of these in its words a document matches no rule and no phrase.
GATE = (
    r"licen[cs]|copyright|copyleft|spdx|cc by|cc0|creative ?commons|public ?domain|(?<= )[al]?gpl|gnu |unlicense|wtfpl|all rights|some rights|"
    r"proprietary|redistribut|permission|(?<= )(?:mpl|epl|cddl|eupl|odbl|osl|busl|bsl|sspl|ofl|pddl) |bsd|apache|mozilla|opensource org|"
    r"openrail|gfdl|mulan|beerware|attribution|unencumbered|same terms as|not evil|creativeml|confidential|"
    r"(?<= )a[ps]l 2 0 |berkeley software|rechte vorbehalten|opendatacommons"
)


def rules() -> list[tuple[int, str, str, str]]:
    """The ordered rules ``(rank, label, keyword, regex)``; a lower rank wins."""
    return [(k, label, word, regex) for k, (label, word, regex) in enumerate((a, b, r) for a, b, many in FAMILIES for r in many)]


def normal_words(text: Column) -> Column:
    """``" w0 w1 ... "``: words with A-Z lower-cased and one space around each, or ``" "``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    spaced = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), NOT_WORD, " "))
    return F.when(spaced == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


#: Items of an array folded at a time: appending to a list costs its length.
BLOCK = 128


def _walked(items: Column, start: Column, kind: str, step) -> Column:
    """A fold over an array that gives a list, in time near its length.

    ``step(state, item)`` returns the new state and an array of none or one element of
    type ``kind``.  Elements are gathered block by block, and the blocks joined at last.
    """
    empty = F.array().cast(f"array<{kind}>")

    def cut(held):
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(held) / BLOCK).cast("int")), lambda n: F.slice(held, n * BLOCK + 1, F.lit(BLOCK)))

    blocks = F.element_at(F.transform(F.array(items), cut), 1)  # the array is made once, not once a block

    def inside(acc, item):
        state, element = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["own"], element).alias("own"), acc["done"].alias("done"))

    def block(acc, part):
        begin = F.struct(acc["state"].alias("state"), empty.alias("own"), acc["done"].alias("done"))
        return F.aggregate(part, begin, inside, lambda a: F.struct(a["state"].alias("state"), F.array_append(a["done"], a["own"]).alias("done")))

    whole = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.aggregate(blocks, whole, block, lambda a: F.flatten(a["done"]))


def _intervals(norm: Column, rule: Column) -> Column:
    """All matches of one rule as ``(start, end, rank, label)`` in characters."""
    regex = F.concat(F.lit("(?<= )(?:"), rule["regex"], F.lit(")(?= )"))
    gaps, found = F.split(norm, regex, F.lit(-1)), F.regexp_extract_all(norm, regex, F.lit(0))
    lengths = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))), lambda x: x["own"].isNotNull())

    def step(at, x):
        s, e = at + x["gap"], at + x["gap"] + x["own"]
        return e, F.array(F.struct(s.alias("s"), e.alias("e"), rule["rank"].alias("rank"), rule["label"].alias("label")))

    return _walked(lengths, F.lit(0), "struct<s:int,e:int,rank:int,label:string>", step)


def _surviving(hits: Column) -> Column:
    """Drop intervals contained in another; of equal ones the lower rank stays.

    In order of start, then longest first, then rank, an interval is contained
    in an earlier one exactly if the furthest end so far reaches its own end.
    """
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["s"].alias("s"), (-h["e"]).alias("back"), h["rank"].alias("rank"), h["label"].alias("label"))))
    kind = "struct<rank:int,label:string,s:int,e:int>"

    def step(far, h):
        own = F.struct(h["rank"].alias("rank"), h["label"].alias("label"), h["s"].alias("s"), (-h["back"]).alias("e"))
        return F.greatest(far, -h["back"]), F.when(-h["back"] > far, F.array(own)).otherwise(F.array().cast(f"array<{kind}>"))

    return _walked(ordered, F.lit(-1), kind, step)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its license detections; nothing is shuffled.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, detections`` where ``detections`` is an array of
    ``(rank, label, s, e)`` over :func:`normal_words`.  Null text counts as
    empty: no words, no detections, empty label strings, score 0.  Repeated rows
    and ids give one result row each; other columns are ignored.
    """
    table = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(label).alias("label"), F.lit(f" {word} ").alias("word"), F.lit(regex).alias("regex")) for k, label, word, regex in rules()])
    out = docs.select(F.col(id_col).alias("doc_id"), normal_words(F.col(text_col)).alias("norm"))
    out = out.withColumn("n_words", (_spaces(F.col("norm")) - 1).cast("long"))
    for k, (phrase, _) in enumerate(BASE):
        size = phrase.count(" ") + 1
        parts = F.when(F.contains(F.col("norm"), F.lit(f" {phrase} ")), F.split(F.col("norm"), f"(?<= ){phrase}(?= )", -1))
        out = out.withColumn(f"parts{k}", parts)
        out = out.withColumn(f"n{k}", F.coalesce(F.size(f"parts{k}") - 1, F.lit(0)).cast("long"))
        out = out.withColumn(f"first{k}", (_spaces(F.element_at(f"parts{k}", 1)) - 1).cast("long"))
        out = out.withColumn(f"last{k}", F.col("n_words") - (_spaces(F.element_at(f"parts{k}", -1)) - 1) - size)
    n = range(len(BASE))
    out = out.withColumn(
        "detections",
        F.when(
            F.col("norm").rlike(GATE),
            _surviving(F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("norm"), r["word"])), lambda r: _intervals(F.col("norm"), r)))),
        ).otherwise(F.array().cast("array<struct<rank:int,label:string,s:int,e:int>>")),
    )
    base = F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    both = F.array_union(base, F.transform("detections", lambda d: d["label"]))
    # a named license counts in full, a mere hint (the last families) less
    hint = F.array(F.lit("other"), F.lit("copyright"), F.lit("all-rights-reserved"), F.lit("proprietary"))
    score = F.when(F.size(F.array_except(both, hint)) > 0, F.lit(1.0)).when(F.size(both) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        sum((F.col(f"n{k}") for k in n[1:]), F.col("n0")).alias("n_base"),
        F.least(*[F.col(f"first{k}") for k in n]).alias("first_word"),
        F.greatest(*[F.col(f"last{k}") for k in n]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        score.alias("score"),
        "detections",
    )
