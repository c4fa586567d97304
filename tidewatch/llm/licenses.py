"""License scans by ordered signature rules, in DataFrame expressions only.

A text is normalised to lower-case words one blank apart. Rules are regexes over
that form, each gated by a keyword that every match of the regex holds.
Every rule has a priority; a detection whose interval lies inside an earlier
kept interval of the same or a higher priority is suppressed. All of it happens
within the row, so nothing is shuffled and a row's size is the only bound.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, keyword, and the name as a regex over normalised words.
NAMES = """
mit | mit | (?:the )?mit(?: x11| expat)?
mit-0 | mit | mit (?:0|no attribution)
x11 | x11 | x11
expat | expat | expat
isc | isc | isc
apache-1 | apache | apache(?: software)?(?: license)?(?: version)? 1 [01]
apache-2 | apache | apache(?: software)?(?: license)?(?: version)? 2(?: 0)?
bsd-1 | bsd | (?:1|one) clause bsd|bsd 1 clause
bsd-2 | bsd | (?:2|two) clause bsd|bsd 2 clause|simplified bsd|freebsd
bsd-3 | bsd | (?:3|three) clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd
bsd-4 | bsd | (?:4|four) clause bsd|bsd 4 clause|original bsd
bsd-0 | bsd | (?:0|zero) clause bsd|0bsd
gpl-1 | gpl | (?:gnu )?gpl(?: version)? ?v?1(?: 0)?
gpl-2 | gpl | (?:gnu )?gpl(?: version)? ?v?2(?: 0)?(?: only| or later)?
gpl-3 | gpl | (?:gnu )?gpl(?: version)? ?v?3(?: 0)?(?: only| or later)?
gpl | general public | gnu general public
gpl-2 | general public | gnu general public license (?:version |v)2
gpl-3 | general public | gnu general public license (?:version |v)3
lgpl-2 | lgpl | (?:gnu )?lgpl(?: version)? ?v?2(?: 0)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl(?: version)? ?v?2 1
lgpl-3 | lgpl | (?:gnu )?lgpl(?: version)? ?v?3(?: 0)?
lgpl | lesser general | gnu lesser general public
lgpl | library general | gnu library general public
agpl-1 | agpl | (?:gnu )?agpl(?: version)? ?v?1(?: 0)?
agpl-3 | agpl | (?:gnu )?agpl(?: version)? ?v?3(?: 0)?
agpl | affero | gnu affero general public
gfdl | free documentation | gnu free documentation
mpl-1 | mpl | mpl ?v?1 [01]
mpl-2 | mpl | mpl ?v?2(?: 0)?
mpl | mozilla public | mozilla public
epl-1 | epl | epl ?v?1(?: 0)?
epl-2 | epl | epl ?v?2(?: 0)?
epl | eclipse public | eclipse public
edl-1 | eclipse distribution | eclipse distribution
cddl-1 | cddl | cddl(?: version)?(?: 1 [01])?
cddl-1 | common development | common development and distribution
cpl-1 | common public | common public
ipl-1 | ibm public | ibm public
eupl-1 | eupl | eupl(?: v?1 [012])?
eupl-1 | european union public | european union public
cecill-2 | cecill | cecill(?: [abc])?(?: v?2(?: [01])?)?
artistic-1 | artistic | artistic(?: license)? 1(?: 0)?
artistic-2 | artistic | artistic(?: license)? 2(?: 0)?
perl | perl | same terms as perl
bsl-1 | boost | boost software
zlib | zlib | zlib(?: libpng)?
libpng | libpng | libpng
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
beerware | beerware | beerware
postgresql | postgresql | postgresql
psf-2 | python software | python software foundation
php-3 | php | php(?: license)?(?: version)? 3(?: 01?)?
ruby | ruby | ruby
openssl | openssl | openssl
curl | curl | curl
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)?
ms-pl | microsoft public | microsoft public
ms-rl | microsoft reciprocal | microsoft reciprocal
ofl-1 | open font | (?:sil )?open font
upl-1 | universal permissive | universal permissive
osl-3 | open software | open software
afl-3 | academic free | academic free
ecl-2 | educational community | educational community
lppl-1 | latex project | latex project public
vim | vim | vim
w3c | w3c | w3c(?: software)?
odbl-1 | open database | open database
pddl-1 | public domain dedication | public domain dedication
sspl-1 | server side public | server side public
busl-1 | business source | business source
elastic-2 | elastic | elastic(?: license)? 2(?: 0)?
mulan-2 | mulan | mulan (?:psl|permissive software)
cc0-1 | cc0 | cc0(?: 1 0)?
cc-by | cc by | cc by(?: [1-4] [05])?
cc-by-sa | cc by sa | cc by sa(?: [1-4] [05])?
cc-by-nd | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-nc | cc by nc | cc by nc(?: [1-4] [05])?
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by | creative commons attribution | creative commons attribution
cc-by-sa | attribution sharealike | creative commons attribution sharealike
cc-by-nc | attribution noncommercial | creative commons attribution noncommercial
cc-by-nd | attribution noderiv | creative commons attribution noderiv(?:s|atives)
cc-by-nc-sa | noncommercial sharealike | creative commons attribution noncommercial sharealike
cc-by-nc-nd | noncommercial noderiv | creative commons attribution noncommercial noderiv(?:s|atives)
adobe | adobe systems | adobe systems(?: incorporated)?(?: source code)?
agfa | agfa | agfa monotype
aladdin-8 | aladdin | aladdin free public
amazon | amazon software | amazon software
apsl-1 | apple public source | apple public source(?: license)?(?: version)? 1 [012]
apsl-2 | apple public source | apple public source(?: license)?(?: version)? 2(?: 0)?
apsl | apple public source | apple public source
attribution-assurance | attribution assurance | attribution assurance
bahyph | bahyph | bahyph
barr | barr | barr
bigscience-openrail | bigscience | bigscience (?:bloom )?(?:rail|openrail)(?: m)?(?: 1 0)?
bittorrent-1 | bittorrent | bittorrent open source
blueoak-1 | blue oak | blue oak model
borceux | borceux | borceux
bzip2-1 | bzip2 | (?:libbzip2|bzip2)(?: 1 0 [56])?
c-uda-1 | computational use of data | computational use of data(?: agreement)?
caldera | caldera | caldera
catosl-1 | computer associates | computer associates trusted open source
cdla-permissive-1 | data license agreement permissive | community data license agreement permissive(?: version)? 1(?: 0)?
cdla-permissive-2 | data license agreement permissive | community data license agreement permissive(?: version)? 2(?: 0)?
cdla-sharing-1 | data license agreement sharing | community data license agreement sharing
clartistic | clarified artistic | clarified artistic
cnri-python | cnri | cnri(?: open source gpl compatible)? (?:python|jython)
coil-1 | copyfree | copyfree open innovation
condor-1 | condor | condor public
crossword | crossword | crossword
crystal-stacker | crystal stacker | crystal stacker
cua-opl-1 | cua office | cua office public
d-fsl-1 | deutsche freie software | deutsche freie software
digirule | digirule | digirule solutions
dl-de-by-2 | datenlizenz deutschland | datenlizenz deutschland namensnennung(?: 2 0)?
dl-de-zero-2 | datenlizenz deutschland | datenlizenz deutschland zero(?: 2 0)?
dotseqn | dotseqn | dotseqn
ecos-2 | ecos | ecos(?: version)? 2(?: 0)?
efl-2 | eiffel forum | eiffel forum(?: license)?(?: version)? 2
egenix-1 | egenix | egenix com public
entessa-1 | entessa | entessa public
erlpl-1 | erlang public | erlang public
etalab-2 | etalab | etalab(?: open)?(?: 2 0)?
eudatagrid | datagrid | (?:eu )?datagrid software
fair | fair | fair
frameworx-1 | frameworx | frameworx open
freeimage-1 | freeimage | freeimage public
freetype | freetype | freetype(?: project)?
fsf-unlimited | fsf unlimited | fsf unlimited
glide | 3dfx glide | 3dfx glide source code general public
hippocratic-2 | hippocratic | hippocratic(?: license)?(?: version)? 2(?: [01])?
hpnd | historical permission notice | historical permission notice and disclaimer
icu | icu | icu
ijg | independent jpeg group | independent jpeg group(?: s)?
imagemagick | imagemagick | imagemagick
info-zip | info zip | info zip
intel | intel open source | intel open source
jasper-2 | jasper | jasper(?: license)?(?: version)? 2(?: 0)?
json | json | json
lal-1 | free art | free art(?: 1 [23])?
leptonica | leptonica | leptonica
liliq-p | libre du quebec | licence libre du quebec permissive
llama-2 | llama 2 | llama 2 community
llama-3 | llama 3 | llama 3(?: [123])? community
lpl-1 | lucent public | lucent public(?: license)?(?: version)?(?: 1(?: 02?)?)?
miros | miros | miros
motosoto | motosoto | motosoto open source
multics | multics | multics
nasa-1 | nasa open source | nasa open source(?: agreement)?
naumen | naumen | naumen public
net-snmp | net snmp | net snmp
netcdf | netcdf | netcdf
nethack | nethack | nethack general public
nlod-2 | norwegian | norwegian licence for open government data
nokia | nokia open source | nokia open source
npl-1 | netscape public | netscape public(?: license)?(?: version)? 1(?: [01])?
oclc-2 | oclc | oclc research public
odc-by-1 | open data commons attribution | open data commons attribution
ogl-uk-3 | open government | open government(?: licence)?(?: v| version )?3(?: 0)?
oldap-2 | openldap | openldap public
openrail-m | openrail | (?:creativeml )?openrail(?: ?m)?
opl-1 | open publication | open publication
parity-7 | parity public | parity public
polyform-noncommercial-1 | polyform | polyform noncommercial
polyform-small-business-1 | polyform | polyform small business
prosperity-3 | prosperity public | prosperity public
qpl-1 | q public | q public
rpl-1 | reciprocal public | reciprocal public
rpsl-1 | realnetworks | realnetworks public source
ruby | ruby | ruby s
saxpath | saxpath | saxpath
scea | scea | scea(?: shared source)?
sgi-b-2 | sgi free software | sgi free software(?: license)? b(?: version)?(?: 2 0)?
simpl-2 | simple public | simple public
sissl | sun industry standards | sun industry standards source
sleepycat | sleepycat | sleepycat
spl-1 | sun public | sun public
swl | scheme widget | scheme widget library
tcl | tcl tk | tcl tk
torque-1 | torque | torque(?: v2 5)? software
unicode-dfs | unicode | unicode (?:data files and software|terms of use)
vostrom | vostrom | vostrom public
vsl-1 | vovida | vovida software
watcom-1 | watcom | sybase open watcom public
wxwindows | wxwindows | wxwindows(?: library)?
xfree86-1 | xfree86 | xfree86(?: license)?(?: 1 1)?
xnet | x net | x net
xpp | xpp | xpp
yahoo-1 | yahoo public | yahoo public
zend-2 | zend | zend(?: engine)?
zimbra-1 | zimbra public | zimbra public
zpl-2 | zope public | zope public
""".strip()

# Label, keyword and regex of sentences that license texts hold.
SENTENCES = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | without restriction | deal in the software without restriction
isc | permission to use | permission to use copy modify and or distribute this software for any purpose
bsd-3 | neither the name | neither the name of .{1,80}? nor the names of its contributors may be used
bsd-2 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-4 | advertising materials | all advertising materials mentioning features or use of this software
apache-2 | unless required by applicable | unless required by applicable law or agreed to in writing software distributed under the license
apache-2 | apache org licenses | www apache org licenses license 2 0
gpl | gnu general public | redistribute it and or modify it under the terms of the gnu general public license
lgpl | gnu lesser general | under the terms of the gnu lesser general public license
agpl | gnu affero general | under the terms of the gnu affero general public license
gpl | gnu org licenses | www gnu org licenses (?:gpl|old licenses)
mpl-2 | source code form | this source code form is subject to the terms of the mozilla public license
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse
unlicense | unencumbered | this is free and unencumbered software released into the public domain
cc0-1 | waived all copyright | waived all copyright and related or neighboring rights
wtfpl | want to public license | do what the f.ck you want to public license
zlib | origin of this software | the origin of this software must not be misrepresented
bsl-1 | machine executable object | machine executable object code generated by a source language processor
ofl-1 | reserved font | no modified version of the font software may use the reserved font name
public-domain | public domain | (?:is|are|in|into|placed in) the public domain
proprietary | all rights reserved | all rights reserved
proprietary | proprietary and confidential | proprietary and confidential
cc-by | creativecommons org | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons org | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons org | creativecommons org licenses by nc sa [1-4] [05]
""".strip()

#: Confidence by priority.
WEIGHTS = {4: 1.0, 3: 0.95, 2: 0.9, 1: 0.6}


def rules() -> list[tuple[str, int, str, str]]:
    """(keyword, priority, label, regex) in rule order: sentences, then each
    name as an identifier tag, in a grant, and as a mention."""
    fields = lambda table: [[x.strip() for x in line.split(" | ")] for line in table.splitlines()]
    out = [(keyword, 4, label, rx) for label, keyword, rx in fields(SENTENCES)]
    for label, keyword, rx in fields(NAMES):
        out += [
            (keyword, 3, label, f"spdx license identifier (?:{rx})"),
            (
                keyword, 2, label,
                "(?:licensed|released|distributed|available|provided|published|covered|redistributed) (?:under|by) "
                f"(?:the )?(?:terms of )?(?:the )?(?:{rx})(?: public)?(?: licen[sc]e)?",
            ),
            (keyword, 1, label, f"(?:{rx})(?: public)? licen[sc]e"),
        ]
    # Words stand whole: a blank before, and one ahead that stays unread.
    whole = lambda k: f"{'' if k in INSIDE else ' '}{k}{'' if k in GLUED else ' '}"
    return [(whole(k) if " " not in k and len(k) < 5 else k, p, label, f" (?:{rx})(?= )") for k, p, label, rx in out]


#: Short keywords that a match may hold with more letters behind (``gplv2``) or before (``freebsd``).
GLUED, INSIDE = {"gpl", "lgpl", "agpl", "mpl", "epl"}, {"bsd"}
#: What any match must hold, from the templates and the sentences' keywords: one
#: pass decides for most texts.
GATE = "|".join(
    ["licen[sc]", "spdx", "(?:released|distributed|available|provided|published|covered|redistributed) (?:under|by) "]
    + sorted({line.split(" | ")[1].strip() for line in SENTENCES.splitlines()})
)


def normalised(text: Column) -> Column:
    """Lower-case words of a text, one blank apart, without outer blanks. Only
    A-Z change case, and a word is a run of digits, letters and non-ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, r"[^0-9a-z\x{80}-\x{10FFFF}]+", " "))


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def detections(padded: Column) -> Column:
    """Kept detections of a normalised text with a blank at either end:
    array<struct<start, end, priority, label>>, offsets into it."""
    table = F.array(
        *(F.struct(F.lit(k).alias("keyword"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(rx).alias("regex"), F.lit(i).alias("rule"))
          for i, (k, p, label, rx) in enumerate(rules()))
    )
    tried = F.filter(table, lambda r: F.contains(padded, r["keyword"]))

    def spans(r: Column) -> Column:
        found = F.arrays_zip(F.regexp_extract_all(padded, r["regex"], F.lit(0)).alias("m"), F.split(padded, r["regex"], -1).alias("gap"))
        # A gap longer than the matches closes the text: its match is null.
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,back:int,low:int,rule:int,label:string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["gap"])
            b = a + F.length(x["m"])
            one = F.struct(a.alias("start"), (-b).alias("back"), (-r["priority"]).alias("low"), r["rule"].alias("rule"), r["label"].alias("label"))
            return F.struct(b.alias("at"), F.array_append(acc["out"], one).alias("out"))

        return F.aggregate(F.filter(found, lambda x: x["m"].isNotNull()), first, step, lambda acc: acc["out"])

    # Sorted by start, then the longer, then the higher priority, then the rule.
    ordered = F.array_sort(F.flatten(F.transform(tried, spans)))
    levels = sorted(WEIGHTS)
    start = F.struct(
        *(F.lit(-1).alias(f"reach{p}") for p in levels),
        F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>").alias("kept"),
    )

    def sweep(acc: Column, x: Column) -> Column:
        end, priority = -x["back"], -x["low"]
        reach = F.lit(-1)
        for p in levels:
            reach = F.when(priority == p, acc[f"reach{p}"]).otherwise(reach)
        one = F.struct(x["start"].alias("start"), end.alias("end"), priority.alias("priority"), x["label"].alias("label"))
        grown = [F.when(priority >= p, F.greatest(acc[f"reach{p}"], end)).otherwise(acc[f"reach{p}"]).alias(f"reach{p}") for p in levels]
        return F.struct(*grown, F.when(reach >= end, acc["kept"]).otherwise(F.array_append(acc["kept"], one)).alias("kept"))

    return F.aggregate(ordered, start, sweep, lambda acc: acc["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, detections,
    labels, score) for each row.

    A null, empty or wordless text has no words, null places, empty labels and
    score 0. Labels are the base phrases' and the kept detections', distinct and
    sorted. Rows are judged alone: repeated rows repeat, null ids stay null,
    other columns are ignored, an empty table stays empty.
    """
    words = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("body"))
    body = F.col("body")
    words = words.select(
        "doc_id", F.concat(F.lit(" "), body, F.lit(" ")).alias("padded"),
        F.when(body == "", 0).otherwise(_blanks(body) + 1).cast("long").alias("n_words"),
    )
    padded = F.col("padded")
    cuts = {
        label: F.when(F.contains(padded, F.lit(f" {phrase} ")), F.split(padded, f" {phrase}(?= )", -1)) for phrase, label in BASE.items()
    }
    empty = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    cut = words.select(
        "doc_id", "n_words",
        *(c.alias(f"cut_{i}") for i, c in enumerate(cuts.values())),
        F.when(padded.rlike(GATE), detections(padded)).otherwise(empty).alias("detections"),
    )
    count = [F.when(F.col(f"cut_{i}").isNull(), 0).otherwise(F.size(f"cut_{i}") - 1) for i in range(len(BASE))]
    first = [_blanks(F.col(f"cut_{i}")[0]).cast("long") for i in range(len(BASE))]
    last = [
        F.col("n_words") - (_blanks(F.element_at(f"cut_{i}", -1)) - 1) - len(phrase.split()) for i, phrase in enumerate(BASE)
    ]
    base = F.array_compact(F.array(*(F.when(F.col(f"cut_{i}").isNotNull(), F.lit(label)) for i, label in enumerate(BASE.values()))))
    kept = F.transform("detections", lambda d: d["label"])
    weight = F.lit(0.0)
    for p, w in WEIGHTS.items():
        weight = F.greatest(weight, F.when(F.array_contains(F.transform("detections", lambda d: d["priority"]), p), w).otherwise(0.0))
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return cut.select(
        "doc_id", "n_words", sum(count[1:], count[0]).cast("long").alias("n_base"),
        F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        join(base).alias("base_labels"), "detections", join(F.concat(base, kept)).alias("labels"),
        F.greatest(weight, F.when(F.size(base) > 0, 0.95).otherwise(0.0)).alias("score"),
    )
