"""License scans by ordered signature rules, in DataFrame functions only.

A text is normalised to lower-case words (A-Z lowered; ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) with one space around each,
so the rules need no punctuation or line ends. A keyword prefilter in two steps finds which rules a text can match at all: a
few roots, of which every keyword holds one, pass over all texts, and only what they let through is asked for the keywords.
A rule of a keyword found is tried as a literal pattern, which each task compiles once.

All matches of all rules become intervals of words. One that lies within another's is suppressed, and of rules that match the
same interval the first in order of priority stays, so `gnu general public license version 2 or later` is one
GPL-2.0-or-later grant, not also a GPL-2.0 and a bare GPL mention. Intervals that merely overlap both stay. A rule's weight says
how sure a match is; a text's score is the chance that at least one of the rules that stay holds, taking them as independent.

Four base phrases are counted apart from the rules, with all places and the first and last place; their labels always stay.

Defined cases: a null text is empty, with no words, places or labels and score 0; rows that repeat a doc_id are scanned one
by one; the text is scanned whole whatever its length: a rule's cost is linear in it, and suppression sorts the matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Rules in order of priority. A line has label | keyword | weight | pattern over normalised words. The keyword is text that
#: every match has in it or around it (an underscore is a space), so that looking for it first loses nothing; {v} in a label
#: or pattern stands for each version after the block's name, one rule for each. Full grants come before names, names with
#: versions before names without, and mentions last. {named} are beginnings of names that other rules know.
SIGNATURES = r"""
[spdx: 1 2 3 4]
agpl-3.0-or-later | spdx | 0.99 | spdx license identifier agpl 3 0 or later
agpl-3.0-only | spdx | 0.99 | spdx license identifier agpl 3 0(?: only)?
lgpl-{v}.0-or-later | spdx | 0.99 | spdx license identifier lgpl {v} 0 or later
lgpl-{v}.1-or-later | spdx | 0.99 | spdx license identifier lgpl {v} 1 or later
lgpl-{v}.0-only | spdx | 0.99 | spdx license identifier lgpl {v} 0(?: only)?
lgpl-{v}.1-only | spdx | 0.99 | spdx license identifier lgpl {v} 1(?: only)?
gpl-{v}.0-or-later | spdx | 0.99 | spdx license identifier gpl {v} 0 or later
gpl-{v}.0-only | spdx | 0.99 | spdx license identifier gpl {v} 0(?: only)?
mpl-{v}.0 | spdx | 0.99 | spdx license identifier mpl {v} 0
epl-{v}.0 | spdx | 0.99 | spdx license identifier epl {v} 0
apache-{v}.0 | spdx | 0.99 | spdx license identifier apache {v} 0
bsd-{v}-clause | spdx | 0.99 | spdx license identifier bsd {v} clause
cc-by-{v}.0 | spdx | 0.99 | spdx license identifier cc by {v} 0
cc-by-sa-{v}.0 | spdx | 0.99 | spdx license identifier cc by sa {v} 0
cc-by-nc-{v}.0 | spdx | 0.99 | spdx license identifier cc by nc {v} 0
cc0-1.0 | spdx | 0.99 | spdx license identifier cc0 1 0
mit | spdx | 0.99 | spdx license identifier mit
isc | spdx | 0.99 | spdx license identifier isc
zlib | spdx | 0.99 | spdx license identifier zlib
unlicense | spdx | 0.99 | spdx license identifier unlicense
other-spdx | spdx | 0.9 | spdx license identifier [a-z0-9]+

[grants: 1 2 3]
agpl-3.0-or-later | affero general public | 0.98 | gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:at your option )?(?:any )?later(?: version)?
lgpl-{v}.0-or-later | lesser general public | 0.98 | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version {v}(?: 0)? (?:of the license )?or (?:at your option )?(?:any )?later(?: version)?
lgpl-{v}.1-or-later | lesser general public | 0.98 | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version {v} 1 (?:of the license )?or (?:at your option )?(?:any )?later(?: version)?
gpl-{v}.0-or-later | gnu general public | 0.98 | gnu general public license (?:as published by the free software foundation )?(?:either )?version {v}(?: 0)? (?:of the license )?or (?:at your option )?(?:any )?later(?: version)?
apache-2.0 | _apache_ | 0.98 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
mit | permission is hereby | 0.98 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-no-attribution | permission is hereby | 0.97 | permission is hereby granted free of charge to any person obtaining a copy of this software to deal in
isc | permission to use | 0.98 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
ntp | permission to use | 0.95 | permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted
bsd-3-clause | redistribution and use | 0.95 | redistribution and use in source and binary forms with or without modification are permitted .{0,900}?neither the name
bsd-2-clause | redistribution and use | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
zlib | held liable | 0.95 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
boost-1.0 | boost software | 0.97 | boost software license version 1 0
unlicense | unencumbered | 0.98 | this is free and unencumbered software released into the public domain
wtfpl | want to public licen | 0.97 | do what the fuck you want to public license
cc0-1.0 | by waiving | 0.9 | has dedicated the work to the public domain by waiving
cc0-1.0 | waived all copyright | 0.9 | has waived all copyright and related
no-warranty | warranties or conditions | 0.5 | (?:provided|distributed) (?:on an )?as is (?:basis )?without warranties or conditions of any kind

[creative commons: 1 2 3 4]
cc-by-nc-sa-{v}.0 | cc by | 0.95 | cc by nc sa {v} 0
cc-by-nc-nd-{v}.0 | cc by | 0.95 | cc by nc nd {v} 0
cc-by-nc-{v}.0 | cc by | 0.95 | cc by nc {v} 0
cc-by-sa-{v}.0 | cc by | 0.95 | cc by sa {v} 0
cc-by-nd-{v}.0 | cc by | 0.95 | cc by nd {v} 0
cc-by-{v}.0 | cc by | 0.95 | cc by {v} 0
cc-by-nc-sa-{v}.0 | commons | 0.95 | creative commons attribution non ?commercial share ?alike {v} 0(?: international| unported| generic)?
cc-by-nc-nd-{v}.0 | commons | 0.95 | creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s {v} 0(?: international| unported| generic)?
cc-by-nc-{v}.0 | commons | 0.95 | creative commons attribution non ?commercial {v} 0(?: international| unported| generic)?
cc-by-sa-{v}.0 | commons | 0.95 | creative commons attribution share ?alike {v} 0(?: international| unported| generic)?
cc-by-nd-{v}.0 | commons | 0.95 | creative commons attribution no ?deriv(?:ative|ative work)?s {v} 0(?: international| unported| generic)?
cc-by-{v}.0 | commons | 0.95 | creative commons attribution {v} 0(?: international| unported| generic)?
cc-by-nc-sa-{v}.0 | creativecommons | 0.95 | creativecommons org licenses by nc sa {v} 0
cc-by-nc-nd-{v}.0 | creativecommons | 0.95 | creativecommons org licenses by nc nd {v} 0
cc-by-nc-{v}.0 | creativecommons | 0.95 | creativecommons org licenses by nc {v} 0
cc-by-sa-{v}.0 | creativecommons | 0.95 | creativecommons org licenses by sa {v} 0
cc-by-nd-{v}.0 | creativecommons | 0.95 | creativecommons org licenses by nd {v} 0
cc-by-{v}.0 | creativecommons | 0.95 | creativecommons org licenses by {v} 0

[creative commons without version]
cc0-1.0 | commons zero | 0.9 | creative commons zero(?: 1 0)?(?: universal)?
cc0-1.0 | cc0 | 0.9 | cc0(?: 1 0)?(?: universal)?
cc-by-nc-sa | cc by | 0.85 | cc by nc sa
cc-by-nc-nd | cc by | 0.85 | cc by nc nd
cc-by-nc | cc by | 0.85 | cc by nc
cc-by-sa | cc by | 0.85 | cc by sa
cc-by-nd | cc by | 0.85 | cc by nd
cc-by | commons | 0.8 | creative commons attribution
cc-public-domain | creativecommons | 0.9 | creativecommons org publicdomain
creative-commons | commons | 0.6 | creative commons

[gnu: 1 2 3]
agpl-{v}.0 | affero general public | 0.95 | (?:gnu )?affero general public license (?:agpl )?(?:version|v) ?{v}(?: 0)?
lgpl-{v}.0 | lesser general public | 0.95 | (?:gnu )?lesser general public license (?:lgpl )?(?:version|v) ?{v}(?: 0)?
lgpl-{v}.1 | lesser general public | 0.95 | (?:gnu )?lesser general public license (?:lgpl )?(?:version|v) ?{v} 1
lgpl-{v}.0 | library general public | 0.95 | gnu library general public license (?:lgpl )?(?:version|v) ?{v}(?: 0)?
gpl-{v}.0 | gnu general public | 0.95 | gnu general public license (?:gpl )?(?:version|v) ?{v}(?: 0)?
gfdl-1.{v} | free documentation licen | 0.95 | gnu free documentation license (?:gfdl )?(?:version|v) ?1 {v}
agpl-{v}.0 | agpl | 0.9 | (?:gnu )?agpl ?v? ?{v}(?: 0)?(?: only)?
lgpl-{v}.0 | lgpl | 0.9 | (?:gnu )?lgpl ?v? ?{v}(?: 0)?(?: only)?
gpl-{v}.0 | gpl | 0.9 | (?:gnu )?gpl ?v? ?{v}(?: 0)?(?: only)?
lgpl-{v}.1 | lgpl | 0.9 | (?:gnu )?lgpl ?v? ?{v} 1(?: only)?
agpl-{v}.0-or-later | agpl | 0.95 | (?:gnu )?agpl ?v? ?{v}(?: 0)? or (?:any )?later(?: version)?
lgpl-{v}.0-or-later | lgpl | 0.95 | (?:gnu )?lgpl ?v? ?{v}(?: 0)? or (?:any )?later(?: version)?
lgpl-{v}.1-or-later | lgpl | 0.95 | (?:gnu )?lgpl ?v? ?{v} 1 or (?:any )?later(?: version)?
gpl-{v}.0-or-later | gpl | 0.95 | (?:gnu )?gpl ?v? ?{v}(?: 0)? or (?:any )?later(?: version)?
gpl-{v}.0-with-classpath-exception | gnu general public | 0.95 | gnu general public license (?:gpl )?(?:version|v) ?{v}(?: 0)? (?:only |or (?:at your option )?(?:any )?later(?: version)? )?with (?:the )?(?:gnu )?classpath exception

[gnu without version]
gpl-with-classpath-exception | gnu general public | 0.9 | gnu general public license .{0,60}?classpath exception
gpl-with-linking-exception | gnu general public | 0.85 | gnu general public license .{0,60}?linking exception
agpl | affero general public | 0.85 | (?:gnu )?affero general public license
lgpl | lesser general public | 0.85 | (?:gnu )?lesser general public license
lgpl | library general public | 0.85 | gnu library general public license
gfdl | free documentation licen | 0.85 | gnu free documentation license
agpl | agpl | 0.6 | agpl
lgpl | lgpl | 0.6 | lgpl
gpl | gpl | 0.6 | (?:gnu )?gpl

[names: 1 2 3]
apache-{v}.0 | _apache_ | 0.95 | apache (?:software )?license (?:version|v) ?{v}(?: 0)?
apache-{v}.0 | _apache_ | 0.9 | apache (?:license )?{v} 0
mpl-{v}.0 | mozilla public licen | 0.95 | mozilla public license (?:mpl )?(?:(?:version|v) ?)?{v}(?: 0)?
mpl-{v}.1 | mozilla public licen | 0.95 | mozilla public license (?:mpl )?(?:(?:version|v) ?)?{v} 1
mpl-{v}.0 | _mpl_ | 0.9 | mpl (?:v ?)?{v} 0
epl-{v}.0 | eclipse public licen | 0.95 | eclipse public license (?:epl )?(?:(?:version|v) ?)?{v}(?: 0)?
epl-{v}.0 | _epl_ | 0.9 | epl (?:v ?)?{v} 0
cddl-{v}.0 | distribution licen | 0.95 | common development and distribution license (?:cddl )?(?:(?:version|v) ?)?{v}(?: 0)?
cddl-{v}.0 | _cddl_ | 0.9 | cddl (?:v ?)?{v} 0
cpl-{v}.0 | common public licen | 0.95 | common public license (?:version|v) ?{v}(?: 0)?
eupl-1.{v} | european union public licen | 0.95 | european union public licence (?:version|v) ?1 {v}
eupl-1.{v} | _eupl_ | 0.9 | eupl (?:v ?)?1 {v}
afl-{v}.0 | academic free licen | 0.95 | academic free license (?:version|v) ?{v}(?: 0)?
osl-{v}.0 | open software license | 0.95 | open software license (?:version|v) ?{v}(?: 0)?
artistic-{v}.0 | artistic license | 0.95 | artistic license (?:version|v)? ?{v}(?: 0)?
psf-{v} | foundation licen | 0.95 | python software foundation license (?:version|v) ?{v}
lppl-1.{v} | latex project public licen | 0.95 | latex project public license (?:version|v) ?1 {v}
ofl-1.{v} | sil open font licen | 0.95 | sil open font license (?:version|v) ?1 {v}
odbl-{v}.0 | database license | 0.95 | open (?:data commons open )?database license (?:version|v)? ?{v}(?: 0)?
cecill-{v}.0 | cecill | 0.95 | cecill (?:free software license agreement )?(?:version|v)? ?{v}(?: 0)?
ms-pl-{v} | microsoft public licen | 0.9 | microsoft public license (?:version|v) ?{v}
bsd-{v}-clause | bsd {v} clause | 0.95 | bsd {v} clause(?: license)?
bsd-{v}-clause | {v} clause bsd | 0.95 | {v} clause bsd(?: license)?
upl-{v}.0 | universal permissive licen | 0.95 | universal permissive license (?:version|v) ?{v}(?: 0)?

[names without version]
apache | _apache_ | 0.8 | apache software license
apache | _apache_ | 0.75 | apache licensed?
mpl | mozilla public licen | 0.8 | mozilla public licen[cs]e
epl | eclipse public licen | 0.8 | eclipse public licen[cs]e
cddl | distribution licen | 0.8 | common development and distribution licen[cs]e
cpl | common public license | 0.8 | common public license
eupl | european union public licen | 0.8 | european union public licen[cs]e
afl | academic free licen | 0.8 | academic free licen[cs]e
osl | open software licen | 0.7 | open software licen[cs]e
artistic | artistic licen | 0.8 | (?:perl )?artistic licen[cs]e
psf | python | 0.8 | python (?:software foundation )?licen[cs]e
lppl | latex project public licen | 0.8 | latex project public licen[cs]e
ofl | open font licen | 0.8 | open font licen[cs]e
odbl | database licen | 0.8 | open database licen[cs]e
odc-by | data commons | 0.8 | open data commons attribution licen[cs]e
pddl | public domain dedication | 0.8 | public domain dedication and licen[cs]e
cecill | cecill | 0.7 | cecill
ms-pl | microsoft public licen | 0.8 | microsoft public licen[cs]e
ms-rl | reciprocal licen | 0.8 | microsoft reciprocal licen[cs]e
boost | boost software | 0.8 | boost software licen[cs]e
isc | isc licen | 0.8 | isc licen[cs]e
zlib | _zlib_ | 0.8 | zlib(?: libpng)? licen[cs]e
libpng | libpng licen | 0.8 | libpng licen[cs]e
x11 | x11 licen | 0.8 | x11 licen[cs]e
mit-expat | expat licen | 0.8 | expat licen[cs]e
bsd | bsd_ | 0.8 | (?:new |modified |revised |simplified |original |free)?bsd (?:style )?licen[cs]ed?
unlicense | unlicense | 0.8 | (?:the )?unlicense
wtfpl | wtfpl | 0.8 | wtfpl
openssl | openssl licen | 0.8 | openssl licen[cs]e
php | php licen | 0.8 | php licen[cs]e
ruby | ruby licen | 0.8 | ruby licen[cs]e
postgresql | postgresql licen | 0.8 | postgresql licen[cs]e
sspl | server side public licen | 0.8 | server side public licen[cs]e
busl | business source licen | 0.8 | business source licen[cs]e
elastic | elastic licen | 0.8 | elastic licen[cs]e
openrail | open rail | 0.7 | (?:creativeml )?open rail(?: [ms])?
openrail | openrail | 0.7 | (?:creativeml )?openrail(?: [ms])?
llama | community licen | 0.8 | llama (?:[0-9] )*community licen[cs]e
opl | open publication licen | 0.8 | open publication licen[cs]e
fal | free art licen | 0.8 | free art licen[cs]e
ogl | open government licen | 0.8 | open government licen[cs]e

[grants by name]
mit | mit licen | 0.95 | (?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | mit licen | 0.9 | mit licensed?
public-domain | public domain | 0.9 | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | public domain | 0.6 | public domain
proprietary | rights reserved | 0.8 | all rights reserved
proprietary | proprietary | 0.7 | proprietary (?:and confidential|licen[cs]e|software)
non-commercial | commercial use | 0.6 | (?:for )?non ?commercial use(?: only)?
research-only | _research_ | 0.6 | (?:for )?research (?:use|purposes) only
no-redistribution | not redistribute | 0.6 | (?:do|may|must) not redistribute
copyleft | copyleft | 0.5 | copyleft
copyright-notice | copyright | 0.4 | copyright (?:c |© )?[0-9]{4}
open-source | open source licen | 0.3 | open source licen[cs]e
license-unknown | licensed under | 0.3 | licensed under(?: an?)?+(?: the)?+(?: terms of)?+(?: the)?+ (?!{named})[^ ]+
license-unknown | licenced under | 0.3 | licenced under(?: an?)?+(?: the)?+(?: terms of)?+(?: the)?+ (?!{named})[^ ]+
license-unknown | license agreement | 0.2 | license agreement
license-unknown | licence agreement | 0.2 | licence agreement
"""

#: What the texts are asked for first: every keyword holds one of these.
ROOTS = (
    *(" apache ", " cddl ", " epl ", " eupl ", " mpl ", " research ", "boost software", "bsd", "cc by", "cc0", "cecill", "commercial use"),
    *("commons", "copyleft", "copyright", "general public", "gpl", "held liable", "licen", "open rail", "openrail", "permission", "proprietary"),
    *("public domain", "python", "redistribut", "rights reserved", "spdx", "unencumbered", "waiv", "warranties or", "wtfpl", "zlib"),
)

_VERSIONS = ("1", "2", "3", "4")
_NAMED = "(?:gnu|[al]?gpl|gplv[123]|affero|lesser|apache|mit|bsd|[234] clause|mozilla|mpl|eclipse|epl|creative|cc|cc0|isc|zlib|boost|artistic|cddl|eupl|unlicense|expat|x11) "


def rules() -> list[tuple[str, str, float, str]]:
    """(label, keyword, weight, pattern) in order of priority; the pattern's first group is the match, between two spaces."""
    found, versions = [], _VERSIONS
    for line in SIGNATURES.strip().splitlines():
        if line.startswith("["):
            named = line.strip("[]").partition(":")[2].split()
            versions = tuple(named) or _VERSIONS
        elif line.strip():
            label, keyword, weight, pattern = (x.strip() for x in line.split(" | "))
            for v in versions if "{v}" in line else ("",):
                put = lambda x, v=v: x.replace("{v}", v).replace("{named}", _NAMED)
                found.append((put(label), put(keyword).replace("_", " "), float(weight), f" ({put(pattern)})(?= )"))
    return found


def normalised(text: Column) -> Column:
    """Lower-case words, one space before and after each; two spaces if there is none.

    Letters beyond ASCII are lowered too, which is faster and makes no difference to words or rules; but for the two letters
    whose lower case has an ASCII letter in it.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K")), lower_ascii(text)).otherwise(F.lower(text))
    plain = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.concat(F.lit(" "), plain, F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _any(found: list[Column]) -> Column:
    return reduce(Column.__or__, found)


def _tried(t: Column) -> Column:
    """The numbers (from 1, by priority) of the rules that match."""
    by_keyword: dict[str, list[Column]] = {}
    for i, (_, keyword, _, pattern) in enumerate(rules(), 1):
        by_keyword.setdefault(keyword, []).append(F.when(F.rlike(t, F.lit(pattern)), F.lit(i)))
    groups = [F.when(F.contains(t, F.lit(keyword)), F.array(*found)) for keyword, found in by_keyword.items()]
    return F.array_compact(F.flatten(F.array_compact(F.array(*groups))))


def _marked(words: Column, sign: str, begins: bool) -> Column:
    """The indices of the words that begin or end with the sign."""
    holds = F.startswith if begins else F.endswith
    return F.array_compact(F.transform(words, lambda x, i: F.when(holds(x, F.lit(sign)), i)))


def _places(t: Column, rule: Column) -> Column:
    """(first word, minus the last word, rule) of all matches of the rule, which are marked in the text and found by word."""
    pattern = F.element_at(F.array(*(F.lit(r[3]) for r in rules())), rule)
    words = F.split(F.regexp_replace(t, pattern, F.lit(" \x01$1\x02")), " ")
    both = F.arrays_zip(_marked(words, "\x01", True).alias("first"), _marked(words, "\x02", False).alias("last"))
    return F.transform(both, lambda x: F.struct(x["first"].alias("first"), (-x["last"]).alias("last"), rule.alias("rule")))


def _kept(places: Column) -> Column:
    """Rules with a place that lies in no other's.

    By first word, longest first, then by priority, a place lies in an earlier one if and only if one has reached its last word.
    """
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<int>").alias("rules"))

    def step(a: Column, x: Column) -> Column:
        known = F.when(F.array_contains(a["rules"], x["rule"]), a["rules"]).otherwise(F.array_append(a["rules"], x["rule"]))
        return F.when(-x["last"] <= a["reach"], a).otherwise(F.struct((-x["last"]).alias("reach"), known.alias("rules")))

    return F.aggregate(F.sort_array(places), start, step, lambda a: a["rules"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs`` (doc_id, text)."""
    at = docs.select("doc_id", "text", normalised(F.col("text")).alias("_t"))
    gate = _any([F.contains(F.col("_t"), F.lit(x)) for x in ROOTS])
    # a plus after a version of the GPL means what `or later` does; it is punctuation, so rules would not see it
    plus = F.contains(F.col("_t"), F.lit("gpl")) & F.contains(F.col("text"), F.lit("+"))
    ruled = F.when(plus, normalised(F.regexp_replace("text", r"(?i)(gpl\S{0,6}[0-9])\+", "$1 or later"))).otherwise(F.col("_t"))
    at = at.select("doc_id", "_t", (_spaces(F.col("_t")) - 1).cast("long").alias("_n"), F.when(gate, ruled).alias("_r"))
    at = at.select("*", F.when(F.col("_r").isNotNull(), _tried(F.col("_r"))).alias("_i"))
    at = at.select("*", F.when(F.size("_i") > 0, _kept(F.flatten(F.transform("_i", lambda i: _places(F.col("_r"), i))))).alias("_k"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        found = F.col("_r").isNotNull() & F.col("_t").contains(f" {phrase} ")
        counts.append(F.when(found, F.regexp_count("_t", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(found, _spaces(F.substring("_t", F.lit(1), F.instr("_t", f" {phrase} "))) - 1))
        # the last place is the first in the reversed text; words after the phrase, then words before it
        after = _spaces(F.substring(F.reverse("_t"), F.lit(1), F.instr(F.reverse("_t"), f" {phrase[::-1]} "))) - 1
        lasts.append(F.when(found, _spaces(F.col("_t")) - 1 - after - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    out = at.select("doc_id", "_k", F.when(F.col("_t") == "  ", 0).otherwise(F.col("_n")).cast("long").alias("n_words"), reduce(Column.__add__, counts).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), base.alias("_b"))
    kept = F.coalesce("_k", F.array().cast("array<int>"))
    names, misses = F.array(*(F.lit(r[0]) for r in rules())), F.array(*(F.lit(1 - r[2]) for r in rules()))
    every = F.array_sort(F.array_distinct(F.concat("_b", F.transform(kept, lambda i: F.element_at(names, i)))))
    # a base phrase alone counts half
    miss = F.aggregate(kept, F.pow(F.lit(0.5), F.size("_b").cast("double")), lambda a, i: a * F.element_at(misses, i))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_b", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), (1 - miss).alias("score"))


def op9_license_scans(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
