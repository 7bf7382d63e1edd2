"""op8_license_scans: whole licence notices in their usual wrapped form."""

import re
import textwrap

from curul.llm import licenses
from curul.llm.common import texts

S = licenses.SENTENCES
APACHE = f"{S['apache2-notice']}. {S['apache2-copy']}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{S['apache2-as-is']}. See the License for the specific language."
MIT = f"MIT License\n\nCopyright (c) 2020 Ann\n\n{S['mit-grant']}\n\n{S['mit-keep']}."
BSD = f"{S['bsd-redistribution']}\n\n1. {S['bsd-source']}.\n\n2. {S['bsd-binary']}.\n\n3. Neither the name of Some Company nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at\nhttp://www.eclipse.org/legal/epl-v10.html"


def notice(work, licence, version, stop):
    kind = "GNU" if licence == "General" else f"GNU {licence.replace(' General', '')}"
    name = f"{kind} General Public License"
    return f"This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.\n\nIt is distributed without hope."


TEXTS = {
    "Apache-2.0": APACHE, "MIT": MIT, "BSD-3-Clause": BSD, "MPL-2.0": MPL, "EPL-1.0": EPL,
    "GPL-2.0-or-later": notice("program", "General", "2", ";"), "GPL-3.0-or-later": notice("program", "General", "3", ":"),
    "LGPL-2.1-or-later": notice("library", "Lesser General", "2.1", ";"), "LGPL-3.0-or-later": notice("library", "Lesser General", "3", ":"),
    "AGPL-3.0-or-later": notice("program", "Affero General", "3", ":"), "ISC": f"{S['isc-grant']}.", "Unlicense": f"{S['unlicense-free']}.",
}


def wrapped(text, mark="", width=64):
    return "\n".join(f"{mark}{line}" for p in text.split("\n") for line in textwrap.wrap(p, width) or [""])


def test_wrapped_notices(spark):
    rows, want = [], {}
    for licence, text in TEXTS.items():
        for mark in ("", "# ", " * ", "// "):
            want[len(rows)] = {licence}
            rows.append((len(rows), "Some words before it.\n\n" + wrapped(text, mark) + "\n\nand after"))
    # A blank line ends a sentence, and so do words that are not of it.
    broken = [S["gpl3-work"].replace("the ", "the\n\n"), f"was {S['mit-released']} once", "Licensed under the Apache License, Version 2.0 or not"]
    for text in broken:
        want[len(rows)] = set()
        rows.append((len(rows), text))
    found = licenses.scanned(texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: {s.licence for s in r.spans} for r in found} == want
    spans = {r.doc_id: [(s.licence, s.last - s.first) for s in r.spans] for r in found}
    assert ("Apache-2.0", 3) in spans[0] or ("Apache-2.0", 2) in spans[0]
    assert all(re.search(licenses.HINTS, sentence) for sentence in S.values())
