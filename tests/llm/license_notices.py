"""Notices as they stand in files, with the labels that the scan gives them, and texts that name no licence."""

NOTICES = """
licensed under the GPL | gpl
distributed under the LGPL | lgpl
This library is licensed under the GNU LGPL. | lgpl
released under the AGPL | agpl
GPL version 3 | gpl-3.0
GPLv3+ | gpl-3.0
GPL-3.0+ | gpl-3.0
GPL v2 or later | gpl-2.0
GPL-2.0-only | gpl-2.0
GPL 2.0 or any later version | gpl-2.0
(GPLv2) | gpl-2.0
GPL-1.0-or-later | gpl-1.0
LGPL version 2.1 | lgpl-2.1
LGPLv3 | lgpl-3.0
LGPL-2.1+ | lgpl-2.1
LGPL 2.0 | lgpl-2.0
GNU Affero GPL version 3 | agpl-3.0
GNU Affero GPL v3 | agpl-3.0
AGPL-3.0-only | agpl-3.0
AGPLv3 or later | agpl-3.0
GNU GPL version 3 | gpl-3.0
GNU GPL v2 | gpl-2.0
MIT licensed | mit
This project is MIT licensed. | mit
BSD licensed | bsd
Apache 2.0 licensed | apache-2.0
GPL licensed | gpl
MPL licensed | mpl
MPL-2.0 | mpl-2.0
MPL 1.1 | mpl-1.1
EPL-2.0 | epl-2.0
EPL 1.0 | epl-1.0
Apache-2.0 | apache-2.0
BSD-3-Clause | bsd-3-clause
BSD-2-Clause | bsd-2-clause
BSD-1-Clause | bsd-1-clause
BSD-4-Clause | bsd-4-clause
0BSD | 0bsd
3-clause BSD | bsd-3-clause
Two-clause BSD | bsd-2-clause
CC BY-SA 4.0 | cc-by-sa-4.0
CC-BY-4.0 | cc-by-4.0
CC BY 3.0 | cc-by-3.0
CC BY-NC 2.0 | cc-by-nc-2.0
CC BY-NC-SA 2.5 | cc-by-nc-sa-2.5
CC-BY-NC-ND-4.0 | cc-by-nc-nd-4.0
CC BY-ND 1.0 | cc-by-nd-1.0
CC0 | cc0-1.0
CC0-1.0 | cc0-1.0
CC0 1.0 Universal license | cc0-1.0
Creative Commons Attribution-ShareAlike License | cc-by-sa
Creative Commons Attribution License | cc-by
Creative Commons Attribution-NonCommercial License | cc-by-nc
Creative Commons Attribution-NoDerivs License | cc-by-nd
Creative Commons Attribution-ShareAlike 4.0 International License | cc-by-sa-4.0
Creative Commons Attribution 3.0 Unported License | cc-by-3.0
Creative Commons Attribution License v4.0 | cc-by-4.0
Creative Commons Attribution-NonCommercial-ShareAlike 2.5 Generic | cc-by-nc-sa-2.5
Text is available under the Creative Commons Attribution-ShareAlike License | cc-by-sa
Except where noted, content is licensed under CC BY. | cc-by
This work is licensed under a Creative Commons Attribution 4.0 International License. | cc-by-4.0
https://creativecommons.org/licenses/by/4.0/ | cc-by-4.0
http://creativecommons.org/licenses/by-nc-nd/3.0 | cc-by-nc-nd-3.0
https://creativecommons.org/publicdomain/zero/1.0/ | cc0-1.0
https://creativecommons.org/publicdomain/mark/1.0/ | cc-pdm-1.0
Mozilla Public License | mpl
Mozilla Public License, v. 2.0 | mpl-2.0
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. | mpl-2.0
Mozilla Public License Version 1.1 | mpl-1.1
under the Mozilla Public License 1.0 | mpl-1.0
http://mozilla.org/MPL/2.0/ | mpl-2.0
Eclipse Public License | epl
Eclipse Public License - v 2.0 | epl-2.0
Eclipse Public License v1.0 | epl-1.0
Eclipse Distribution License v. 1.0 | edl-1.0
Common Development and Distribution License | cddl
Common Development and Distribution License (CDDL) | cddl
CDDL-1.0 | cddl-1.0
CDDL 1.1 | cddl-1.1
Common Public License Version 1.0 | cpl-1.0
Common Public License | cpl
IBM Public License 1.0 | ipl-1.0
European Union Public License | eupl
EUPL-1.2 | eupl-1.2
European Union Public Licence v1.2 | eupl-1.2
European Union Public Licence 1.1 | eupl-1.1
Artistic License | artistic
Artistic-2.0 | artistic-2.0
The Artistic License 2.0 | artistic-2.0
Artistic-1.0 | artistic-1.0
it under the same terms as Perl itself | artistic
Boost Software License | bsl-1.0
Boost Software License - Version 1.0 | bsl-1.0
Distributed under the Boost Software License, Version 1.0. | bsl-1.0
BSL-1.0 | bsl-1.0
Business Source License | busl-1.1
Business Source License 1.1 | busl-1.1
BUSL-1.1 | busl-1.1
Elastic License 2.0 | elastic-2.0
Server Side Public License | sspl-1.0
SSPL-1.0 | sspl-1.0
zlib License | zlib
released under the zlib/libpng license | zlib
libpng license | libpng
OpenSSL License | openssl
This product includes software developed by the OpenSSL Project | openssl
PHP License, version 3.01 | php-3.01
Python Software Foundation License | python-2.0
PSF License | python-2.0
Ruby License | ruby
PostgreSQL License | postgresql
University of Illinois/NCSA Open Source License | ncsa
W3C License | w3c
SIL Open Font License 1.1 | ofl-1.1
OFL-1.1 | ofl-1.1
This Font Software is licensed under the SIL Open Font License, Version 1.1. | ofl-1.1
WTFPL | wtfpl
Do What The Fuck You Want To Public License | wtfpl
The Unlicense | unlicense
This is free and unencumbered software released into the public domain. | unlicense
https://unlicense.org | unlicense
Universal Permissive License | upl-1.0
UPL-1.0 | upl-1.0
Mulan PSL v2 | mulan-psl-2.0
Microsoft Public License | ms-pl
Microsoft Reciprocal License | ms-rl
Open Database License | odbl-1.0
ODbL-1.0 | odbl-1.0
Open Data Commons Attribution License | odc-by-1.0
Open Data Commons Public Domain Dedication and License | pddl-1.0
PDDL-1.0 | pddl-1.0
Public Domain Mark 1.0 license | cc-pdm-1.0
OpenRAIL-M | openrail
CreativeML Open RAIL-M License | openrail
Llama 3 Community License | llama
Meta Llama 2 Community License | llama
All rights reserved. | proprietary
Proprietary and confidential | proprietary
End User License Agreement (EULA) | proprietary
This file is in the public domain. | public-domain
placed in the public domain | public-domain
The MIT License (MIT) | mit
MIT License | mit
Released under the MIT License. | mit
License: MIT | mit
"license": "MIT" | mit
Licensed under the MIT license | mit
MIT/X11 License | mit
Expat License | mit
X11 License | x11
MIT No Attribution License | mit-0
MIT-0 | mit-0
Permission is hereby granted, free of charge, to any person obtaining a copy of this software | mit
https://opensource.org/licenses/MIT | mit
Apache License | apache
Apache License, Version 2.0 | apache,apache-2.0
Licensed under the Apache License, Version 2.0 (the "License"); | apache,apache-2.0
ASL 2.0 | apache-2.0
Apache Software License 1.1 | apache-1.1
http://www.apache.org/licenses/LICENSE-2.0 | apache-2.0
License :: OSI Approved :: BSD License | bsd
License :: OSI Approved :: MIT License | mit
BSD License | bsd
New BSD License | bsd-3-clause
Simplified BSD License | bsd-2-clause
Modified BSD License | bsd-3-clause
FreeBSD License | bsd-2-clause
BSD-style license | bsd
Redistributions of source code must retain the above copyright notice | bsd
ISC License | isc
License: ISC | isc
Copying: zlib | zlib
GNU General Public License | gpl
GNU General Public License v2.0 | gpl,gpl-2.0
GNU General Public License version 3 | gpl,gpl-3.0
under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 | gpl,gpl-3.0
under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 | gpl,gpl-2.0
https://www.gnu.org/licenses/gpl-3.0.html | gpl-3.0
https://www.gnu.org/licenses/old-licenses/gpl-2.0 | gpl-2.0
https://www.gnu.org/licenses/lgpl-3.0 | lgpl-3.0
https://www.gnu.org/licenses/agpl-3.0 | agpl-3.0
GNU Lesser General Public License v2.1 | gpl,lgpl-2.1
GNU Lesser General Public License | gpl,lgpl
GNU Library General Public License v2 | gpl,lgpl-2.0
GNU Affero General Public License v3 | agpl-3.0,gpl
GNU Affero General Public License | agpl,gpl
GNU Free Documentation License | gfdl
GNU Free Documentation License, Version 1.3 | gfdl
"""

SPDX = {
    "MIT": "mit", "MIT-0": "mit-0", "Apache-2.0": "apache-2.0", "Apache-1.1": "apache-1.1", "GPL-2.0-only": "gpl-2.0", "GPL-2.0-or-later": "gpl-2.0",
    "GPL-3.0-only": "gpl-3.0", "GPL-3.0-or-later": "gpl-3.0", "LGPL-2.1-only": "lgpl-2.1", "LGPL-3.0-or-later": "lgpl-3.0", "AGPL-3.0-only": "agpl-3.0",
    "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "0BSD": "0bsd", "ISC": "isc", "MPL-2.0": "mpl-2.0", "EPL-2.0": "epl-2.0", "CDDL-1.0": "cddl-1.0",
    "EUPL-1.2": "eupl-1.2", "Artistic-2.0": "artistic-2.0", "BSL-1.0": "bsl-1.0", "Zlib": "zlib", "PostgreSQL": "postgresql", "NCSA": "ncsa", "OFL-1.1": "ofl-1.1",
    "WTFPL": "wtfpl", "Unlicense": "unlicense", "CC0-1.0": "cc0-1.0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0", "MS-PL": "ms-pl", "BUSL-1.1": "busl-1.1",
}

ORDINARY = """
The general public was invited to the opening.
MIT researchers published a paper on batteries.
An apache helicopter flew over the valley.
The Apache people lived in the southwest.
Boost your software performance with caching.
The eclipse drew a public crowd of thousands.
Mozilla hired two engineers in Berlin.
He is an artistic director at the theatre.
A common public place for development and distribution.
The European Union published a report in 2020.
She drives without a license.
His driving licence was renewed in March.
Fishing licenses are sold at the shop.
The licensee shall call the bar owner.
Creative people share common ideas.
The commons were full of attribution errors.
We share alike in the harvest.
The public domain of the lake is protected.
A ruby ring and a postgresql server.
The library of the university of Illinois has open source books.
Elastic bands come in version 2.0 of the kit.
The server side of the page is public.
Python software runs on every machine.
The foundation of the house is solid.
Mulan is a film about a soldier.
Llama farms are a growing business.
The community met in the hall.
A permissive attitude is universal here.
Unlicensed drivers were fined.
The font was open and the text was dark.
Copying homework is not allowed.
See the details in the next chapter.
Read the file before noon.
Perl and oyster shells were found.
Sources said the code of conduct is provided to all.
The business source of income is unclear.
Data commons are open to all students.
A database was opened by the police.
Microsoft public relations answered the call.
The original BSD release appeared in 1977.
He scored a zero in the clause test.
Two clauses were struck from the contract.
The internet is a system of networks.
The consortium of banks met on Monday.
An affero is not a word that I know.
GNU herds cross the river in June.
Version 3 of the plan was approved.
The terms and conditions of trade are harsh.
Provided by the authors as they see fit.
Released under heavy guard on Tuesday.
Distributed among the villages by truck.
This work is free of errors.
"""


def notices():
    rows = [tuple(x.strip() for x in line.rsplit("|", 1)) for line in NOTICES.strip().splitlines()]
    for tag, label in SPDX.items():
        rows.append((f"// SPDX-License-Identifier: {tag}", label))
    return rows


def ordinary():
    return ORDINARY.strip().splitlines()
