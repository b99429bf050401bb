"""Signatures of licenses: ordered rules of level, label, keyword and regex.

Regexes are written for plain text: A-Z in lower case, words of letters and digits with one blank between them ("GPL-3.0+" reads ``gpl 3 0``).
They match whole words. A text is tried against a rule only if it holds the rule's keyword (blanks at its ends count). Levels, from the surest:

1 wording of the license or of its notice, 2 identifiers and addresses, 3 the name with a version or after words that grant, 4 the bare name,
5 words that speak of rights without a name.
"""

from __future__ import annotations

#: How sure a label is by the level of the rule that gives it.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.75, 5: 0.5}

_HAND_WRITTEN = """
1 | mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 | mit | this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 | mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
2 | mit | identifier | spdx license identifier mit
2 | mit-0 | identifier | spdx license identifier mit 0
2 | mit | opensource org | opensource org licenses? mit(?: license)?(?: php| html)?
3 | mit |  mit  | (?:released|licensed|distributed|available|published|provided|made available) under (?:the|an)(?: terms of the)? mit license
3 | mit |  mit  | (?:under|with|by|uses) (?:an?|the)(?: terms of the)? mit(?: style| type| expat)? license
3 | mit-0 | mit no attribution | mit no attribution(?: license)?
3 | x11 |  x11  | (?:mit )?x11 license
4 | mit |  mit  | mit license
4 | mit |  mit  | licen[cs]e(?: type)? mit
4 | mit | expat | expat license
1 | isc | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
2 | isc | identifier | spdx license identifier isc
3 | isc |  isc  | (?:under|with|by) (?:an?|the)(?: terms of the)? isc(?: style)? license
4 | isc |  isc  | isc license
1 | 0bsd | with or without fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
2 | 0bsd | identifier | spdx license identifier 0bsd
4 | 0bsd | 0bsd | 0bsd
4 | 0bsd | zero clause | zero clause bsd(?: license)?
1 | bsd-3-clause | neither the name | neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software without specific prior written permission
1 | bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 | bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 | bsd-2-clause | identifier | spdx license identifier bsd 2 clause
2 | bsd-3-clause | identifier | spdx license identifier bsd 3 clause
2 | bsd-3-clause | opensource org | opensource org licenses? bsd(?: 3 clause| license)(?: php| html)?
2 | bsd-2-clause | opensource org | opensource org licenses? bsd 2 clause
3 | bsd-2-clause | bsd | (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
3 | bsd-3-clause |  bsd  | (?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?
3 | bsd-4-clause |  bsd  | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?
3 | bsd |  bsd  | (?:under|with|by) (?:an?|the)(?: terms of the)? bsd(?: style| type)? licen[cs]e
4 | bsd |  bsd  | bsd(?: style)? licen[cs]e
1 | apache-2.0 | apache license | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 | apache-2.0 | apache | (?:you may obtain a copy of the license at )(?:https? )?www apache org licenses license 2 0
2 | apache-2.0 | apache | apache org licenses license 2 0(?: txt| html)?
2 | apache-2.0 | identifier | spdx license identifier apache 2 0
2 | apache-1.1 | identifier | spdx license identifier apache 1 1
3 | apache-2.0 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?(?:2 0|2|v2|v2 0)
3 | apache-2.0 | apache | apache (?:2 0|2|v2|v2 0)(?: licen[cs]ed?)?
3 | apache-1.1 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?(?:1 1|v1 1)
3 | apache-1.0 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?(?:1 0|v1 0)
4 | apache | apache | apache(?: software)? licen[cs]e
1 | gpl-1.0-or-later | general public license | gnu general public license as published by the free software foundation either version 1 (?:of the license )?or at your option any later version
1 | gpl-2.0-or-later | general public license | gnu general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version
1 | gpl-3.0-or-later | general public license | gnu general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
1 | gpl-2.0-only | general public license | gnu general public license(?: as published by the free software foundation)? version 2 only
1 | gpl-3.0-only | general public license | gnu general public license(?: as published by the free software foundation)? version 3 only
1 | lgpl-2.1-or-later | lesser general public | gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?or at your option any later version
1 | lgpl-3.0-or-later | lesser general public | gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
1 | agpl-3.0-or-later | affero general public | gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
2 | gpl-2.0-only | identifier | spdx license identifier gpl 2 0(?: only)?
2 | gpl-3.0-only | identifier | spdx license identifier gpl 3 0(?: only)?
2 | gpl-2.0-or-later | identifier | spdx license identifier gpl 2 0 or later
2 | gpl-3.0-or-later | identifier | spdx license identifier gpl 3 0 or later
2 | lgpl-2.1-only | identifier | spdx license identifier lgpl 2 1(?: only)?
2 | lgpl-2.1-or-later | identifier | spdx license identifier lgpl 2 1 or later
2 | lgpl-3.0-only | identifier | spdx license identifier lgpl 3 0(?: only)?
2 | lgpl-3.0-or-later | identifier | spdx license identifier lgpl 3 0 or later
2 | agpl-3.0-only | identifier | spdx license identifier agpl 3 0(?: only)?
2 | agpl-3.0-or-later | identifier | spdx license identifier agpl 3 0 or later
2 | gpl | gnu org | gnu org (?:licenses|copyleft) gpl(?: txt| html)?
2 | lgpl | gnu org | gnu org (?:licenses|copyleft) l(?:esser|gpl)(?: txt| html)?
2 | agpl | gnu org | gnu org licenses agpl(?: txt| html)?
3 | gpl-2.0 | general public license | (?:gnu )?general public license(?: gpl)?(?: version| v)? (?:2|2 0|v2)
3 | gpl-3.0 | general public license | (?:gnu )?general public license(?: gpl)?(?: version| v)? (?:3|3 0|v3)
3 | gpl-2.0 |  gpl | (?:gnu )?(?:gpl(?: version| v)? (?:2|2 0|v2)|gplv2)
3 | gpl-3.0 |  gpl | (?:gnu )?(?:gpl(?: version| v)? (?:3|3 0|v3)|gplv3)
3 | lgpl-2.0 | library general public | (?:gnu )?library general public license(?: version| v)? (?:2|2 0)
3 | lgpl-2.1 | lesser general public | (?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? (?:2 1|v2 1)
3 | lgpl-3.0 | lesser general public | (?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? (?:3|3 0|v3)
3 | lgpl-2.1 | lgpl | (?:gnu )?(?:lgpl(?: version| v)? (?:2 1|v2 1)|lgplv2 1)
3 | lgpl-3.0 | lgpl | (?:gnu )?(?:lgpl(?: version| v)? (?:3|3 0|v3)|lgplv3)
3 | agpl-3.0 | affero | (?:gnu )?affero general public license(?: agpl)?(?: version| v)? (?:3|3 0|v3)
3 | agpl-3.0 | agpl | (?:gnu )?(?:agpl(?: version| v)? (?:3|3 0|v3)|agplv3)
3 | gfdl-1.3 | free documentation | (?:gnu )?free documentation license(?: version| v)? 1 3
3 | gfdl-1.2 | free documentation | (?:gnu )?free documentation license(?: version| v)? 1 2
3 | gfdl-1.1 | free documentation | (?:gnu )?free documentation license(?: version| v)? 1 1
4 | gpl | general public license | (?:gnu )?general public license
4 | gpl |  gpl | (?:gnu gpl|gpl licensed?|gpl)
4 | lgpl | general public license | (?:gnu )?(?:lesser|library) general public license
4 | lgpl | lgpl | (?:gnu )?lgpl
4 | agpl | affero | (?:gnu )?affero general public license
4 | agpl | agpl | (?:gnu )?agpl
4 | gfdl | free documentation | (?:gnu )?free documentation license
4 | gfdl | gfdl | gfdl
3 | classpath-exception-2.0 | classpath exception | (?:with (?:the )?)?classpath exception(?: version)?(?: 2 0)?
3 | gcc-exception-3.1 | gcc runtime library exception | gcc runtime library exception(?: version)?(?: 3 1)?
1 | mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
1 | mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
2 | mpl-2.0 | mozilla org | mozilla org mpl 2 0
2 | mpl-2.0 | identifier | spdx license identifier mpl 2 0
2 | mpl-1.1 | identifier | spdx license identifier mpl 1 1
3 | mpl-2.0 | mozilla public license | mozilla public license(?: mpl)?(?: version| v)? (?:2|2 0|v2)
3 | mpl-1.1 | mozilla public license | mozilla public license(?: mpl)?(?: version| v)? 1 1
3 | mpl-1.0 | mozilla public license | mozilla public license(?: mpl)?(?: version| v)? 1 0
3 | mpl-2.0 |  mpl | mpl(?: version| v)? (?:2|2 0|v2)
3 | mpl-1.1 |  mpl | mpl(?: version| v)? 1 1
4 | mpl | mozilla public license | mozilla public license
1 | epl-2.0 | eclipse public license | made available under the terms of the eclipse public license(?: v)? 2 0
1 | epl-1.0 | eclipse public license | made available under the terms of the eclipse public license v1 0
2 | epl-2.0 | identifier | spdx license identifier epl 2 0
2 | epl-1.0 | identifier | spdx license identifier epl 1 0
2 | epl-2.0 | eclipse org | eclipse org legal epl(?: v)? 2 0
3 | epl-2.0 | eclipse public license | eclipse public license(?: epl)?(?: version| v)? (?:2|2 0|v2)
3 | epl-1.0 | eclipse public license | eclipse public license(?: epl)?(?: version| v)? (?:1|1 0|v1)
4 | epl | eclipse public license | eclipse public license
1 | edl-1.0 | eclipse distribution license | made available under the terms of the eclipse distribution license v(?: 1| 1 0|1 0)
4 | edl-1.0 | eclipse distribution license | eclipse distribution license
1 | cddl-1.0 | development and distribution | the contents of this file are subject to the terms of the common development and distribution license
2 | cddl-1.0 | identifier | spdx license identifier cddl 1 0
2 | cddl-1.1 | identifier | spdx license identifier cddl 1 1
3 | cddl-1.0 | development and distribution | common development and distribution license(?: cddl)?(?: version| v)? 1 0
3 | cddl-1.1 | development and distribution | common development and distribution license(?: cddl)?(?: version| v)? 1 1
4 | cddl | development and distribution | common development and distribution license
3 | cpl-1.0 | common public license | common public license(?: cpl)?(?: version| v)?(?: 1 0)
4 | cpl | common public license | common public license
3 | ipl-1.0 | ibm public license | ibm public license(?: version| v)?(?: 1 0)?
1 | unlicense | released into the public domain | this is free and unencumbered software released into the public domain
2 | unlicense | unlicense | (?:spdx license identifier|https?) unlicense(?: org)?
4 | unlicense | unlicense | (?:the )?unlicense
1 | wtfpl | you just do what | you just do what the fuck you want to
2 | wtfpl | wtfpl | spdx license identifier wtfpl
4 | wtfpl | wtfpl | wtfpl
3 | wtfpl | do what the fuck | do what the fuck you want to public license(?: version 2)?
1 | zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
2 | zlib | identifier | spdx license identifier zlib
4 | zlib | zlib | zlib(?: libpng)? license
1 | bsl-1.0 | boost | distributed under the boost software license version 1 0
2 | bsl-1.0 | boost | boost org license 1 0(?: txt)?
2 | bsl-1.0 | identifier | spdx license identifier bsl 1 0
3 | bsl-1.0 | boost | boost software license(?: version| v)? ?(?:1 0|1)
4 | bsl-1.0 | boost | boost(?: software)? license
1 | artistic-2.0 | artistic license | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed(?: [^ ]+){0,6} artistic license 2 0
2 | artistic-2.0 | identifier | spdx license identifier artistic 2 0
3 | artistic-2.0 | artistic license | (?:perl )?artistic license(?: version| v)? 2(?: 0)?
3 | artistic-1.0 | artistic license | (?:perl )?artistic license(?: version| v)? 1(?: 0)?
4 | artistic | artistic license | (?:perl )?artistic license
1 | psf-2.0 | python software foundation | this license agreement is between the python software foundation psf and the individual or organization
2 | psf-2.0 | identifier | spdx license identifier (?:psf|python) 2 0
3 | psf-2.0 | python software foundation | python software foundation license(?: version)? 2
4 | psf | python software foundation | python software foundation license
4 | psf | psf | psf license
4 | ruby | ruby license | (?:the )?ruby license
4 | php-3.01 | php license | php license(?: version| v)?(?: 3 01| 3 0 1)?
4 | vim | vim license | vim license
4 | postgresql | postgresql license | postgresql license
4 | openssl | openssl license | openssl license
4 | curl | curl license | curl license
4 | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? license
4 | w3c | w3c | w3c (?:software|document)(?: notice)?(?: and)? license
4 | ofl-1.1 | open font license | (?:sil )?open font license(?: ofl)?(?: version| v)?(?: 1 1)?
2 | ofl-1.1 | identifier | spdx license identifier ofl 1 1
4 | afl-3.0 | academic free license | academic free license(?: version| v)?(?: 3 0)?
4 | osl-3.0 | open software license | open software license(?: version| v)?(?: 3 0)?
4 | eupl-1.2 | european union public | european union public licen[cs]e(?: eupl)?(?: version| v)?(?: 1 2)?
3 | eupl-1.1 | european union public | european union public licen[cs]e(?: eupl)?(?: version| v)? 1 1
3 | eupl-1.2 | eupl | eupl(?: version| v)? 1 2
4 | cecill | cecill | cecill(?: free software license agreement)?
3 | cecill-2.1 | cecill | cecill(?: version| v)? 2 1
4 | mulan-psl-2.0 | mulan | mulan psl(?: v| version)?(?: 2| v2)?
4 | ms-pl | microsoft public license | microsoft public license(?: ms pl)?
4 | ms-rl | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
4 | apsl-2.0 | apple public source | apple public source license(?: version| v)?(?: 2 0| 2)?
4 | sleepycat | sleepycat | sleepycat(?: public)? license
4 | beerware | beerware | beerware(?: license)?
4 | beerware | beer ware | (?:the )?beer ware license
4 | json | json license | json license
1 | json | for good not evil | the software shall be used for good not evil
4 | qpl-1.0 | q public license | q public license(?: version)?(?: 1 0)?
4 | upl-1.0 | universal permissive | universal permissive license(?: version| v)?(?: 1 0)?
4 | blueoak-1.0.0 | blue oak | blue oak model license(?: 1 0 0)?
4 | unicode | unicode license | unicode license(?: v3)?
4 | ecl-2.0 | educational community | educational community license(?: version| v)?(?: 2 0| 1 0)?
3 | sspl-1.0 | server side public | server side public license(?: sspl)?(?: version| v)?(?: 1 0| 1)?
3 | elastic-2.0 | elastic license | elastic license(?: version| v)? ?(?:2 0|2|v2)
4 | elastic | elastic license | elastic license
3 | busl-1.1 | business source | business source license(?: version| v)?(?: 1 1)?
3 | polyform-noncommercial | polyform | polyform noncommercial license(?: 1 0 0)?
3 | polyform-small-business | polyform | polyform small business license(?: 1 0 0)?
3 | commons-clause | commons clause | commons clause(?: license condition)?(?: v1 0| 1 0)?
3 | openrail | rail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?
1 | cc0-1.0 | waived all copyright | has waived all copyright and related or neighboring rights
2 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
2 | cc0-1.0 | identifier | spdx license identifier cc0 1 0
3 | cc0-1.0 |  cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
3 | cc0-1.0 | creative commons | creative commons zero(?: v| version)?(?: 1 0)?(?: universal)?
3 | pddl-1.0 | open data commons | open data commons public domain dedication and license(?: pddl)?(?: v1 0)?
3 | odbl-1.0 | open database license | open(?: data commons open)? database license(?: odbl)?(?: v1 0| 1 0)?
3 | odc-by-1.0 | open data commons | open data commons attribution license(?: odc by)?(?: v1 0)?
3 | ogl-uk-3.0 | open government licen | open government licen[cs]e(?: v| version)?(?: 3 0| v3 0)?
3 | cdla-permissive-2.0 | community data license | community data license agreement permissive(?: version)?(?: 2 0)?
3 | cdla-sharing-1.0 | community data license | community data license agreement sharing(?: version)?(?: 1 0)?
4 | cc | creative commons | creative commons(?: public)? licen[cs]e
5 | cc | creative commons | creative commons
3 | public-domain | public domain | (?:released|placed|dedicated|donated|put)(?: in| into| to)? the public domain
4 | public-domain | public domain | (?:is|are) (?:now )?in the public domain
5 | public-domain | public domain | public domain
3 | proprietary | proprietary | (?:this is |the )?(?:confidential and proprietary|proprietary and confidential)(?: information| property)?
3 | proprietary | strictly prohibited | unauthorized (?:copying|reproduction|distribution|use)(?: or distribution)? of (?:[^ ]+ ){1,8}is strictly prohibited
4 | proprietary | all rights reserved | all rights reserved
4 | commercial | commercial license | (?:under|with) a commercial license
4 | non-commercial | commercial | (?:for )?non ?commercial (?:use|purposes)(?: only)?
4 | evaluation-only | evaluation | (?:for )?evaluation purposes only
5 | copyleft | copyleft | copyleft
5 | open-source | open source license | (?:an |approved )?open source license
5 | license-notice | licen | licen[cs]ed under (?:the|an?|these)(?: terms of (?:the|an?))?
5 | license-notice | licen | see the (?:accompanying )?licen[cs]e(?: file| txt| md)?(?: for (?:more )?details)?
5 | license-notice | licen | (?:subject to|in accordance with|under) the terms of (?:the|this) licen[cs]e
5 | warranty-disclaimer | warrant | without (?:any )?warrant(?:y|ies)(?: or conditions)? of any kind
5 | warranty-disclaimer | warrant | without even the implied warranty of merchantability or fitness for a particular purpose
5 | copyright-notice | copyright | copyright(?: c)? (?:19|20)[0-9][0-9]
5 | copyright-notice | copyright | (?:c )?copyright (?:by|c)
"""

#: Creative Commons licenses: their letters, and how their names are spelt out.
_COMMONS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s(?: works)?", "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?",
}
_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _commons() -> list[tuple[int, str, str, str]]:
    """Rules of the Creative Commons family, by letters, version and place: addresses, short names, spelt-out names, names without a version."""
    out = []
    for letters, name in _COMMONS.items():
        short, label = letters.replace("-", " "), f"cc-{letters}"
        for version in _COMMONS_VERSIONS:
            v = version.replace(".", " ")
            out += [
                (2, f"{label}-{version}", "creativecommons", f"creativecommons org licenses {short} {v}"),
                (2, f"{label}-{version}", "identifier", f"spdx license identifier cc {short} {v}"),
                (3, f"{label}-{version}", " cc ", f"(?:license )?cc {short}(?: license)?(?: version| v)? {v}"),
                (3, f"{label}-{version}", "creative commons", f"creative commons (?:{name}|{short})(?: license| public license)?(?: version| v)? {v}(?: international| unported| generic)?(?: license)?"),
            ]
        out += [(4, label, " cc ", f"cc {short}"), (4, label, "creative commons", f"creative commons {name}(?: license)?")]
    return out


def rules() -> list[tuple[int, str, str, str]]:
    """(level, label, keyword, regex) of all rules, in order; of equal detections the earlier rule's stays."""
    out = []
    for line in _HAND_WRITTEN.strip().split("\n"):
        level, label, keyword, regex = line.split(" | ", 3)
        out.append((int(level), label, keyword, regex))
    return out + _commons()
