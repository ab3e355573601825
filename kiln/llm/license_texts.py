"""Templates of the license scan: published license texts, headers and short notices.

``TEMPLATES`` maps a name to its text, ``DECIDING`` to the phrases (name, variant,
version) that tell its license from its relatives, ``BARRED`` to the words that
belong to a relative's text only.  A name is a license id, followed by ``-header`` (the
notice that a license asks for in each file), ``-text`` (title and first words
of a long license), ``-notice``, ``-name`` and ``-id`` (one sentence) or ``-spdx``.
"""

from __future__ import annotations

TEMPLATES: dict[str, str] = {}
DECIDING: dict[str, tuple[str, ...]] = {}
BARRED: dict[str, str] = {}


def _add(name: str, text: str, *deciding: str, barred: str = "") -> None:
    TEMPLATES[name] = text
    if deciding:
        DECIDING[name] = deciding
    if barred:
        BARRED[name] = barred


# ---------------------------------------------------------------- whole texts of short licenses
_add(
    "MIT",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
)
_add(
    "MIT-0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "furnished to do so. THE SOFTWARE IS PROVIDED",
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_NO_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_PROVIDED = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
_add("BSD-2-Clause", _REDISTRIBUTION + _PROVIDED, "Redistribution and use", "SOFTWARE IS PROVIDED", barred="neither endorse promote advertising")
_add("BSD-3-Clause", _REDISTRIBUTION + _NO_ENDORSEMENT + _PROVIDED, "Redistribution and use", "endorse or promote", barred="advertising")
_add(
    "BSD-4-Clause",
    _REDISTRIBUTION + "All advertising materials mentioning features or use of this software must display the "
    "following acknowledgement: This product includes software developed by " + _NO_ENDORSEMENT + _PROVIDED,
    "Redistribution and use", "advertising materials", "endorse or promote",
)
_add(
    "ISC",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "provided that the above copyright notice", barred="documentation",
)
_add(
    "0BSD",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "hereby granted. THE SOFTWARE",
)
_add(
    "Zlib",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
    "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
    "to the following restrictions: The origin of this software must not be misrepresented; you must not claim that "
    "you wrote the original software.",
    "must not be misrepresented",
)
_add(
    "BSL-1.0",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
    "execute, and transmit the Software, and to prepare derivative works of the Software",
    "person or organization",
)
_add(
    "Unlicense",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.",
    "free and unencumbered",
)

# ---------------------------------------------------------------- file headers
_add(
    "Apache-2.0-header",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
    "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License.",
    "Apache License, Version 2.0",
)
_GNU_HEADER = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} "
    "as published by the Free Software Foundation, either version {version} of the License, or (at your "
    "option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_GNU = (
    ("GPL-2.0", "program", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "program", "GNU General Public License", "3", "29 June 2007"),
    ("LGPL-2.0", "library", "GNU Library General Public License", "2", "June 1991"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "library", "GNU Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "program", "GNU Affero General Public License", "3", "19 November 2007"),
)
for _id, _what, _name, _version, _day in _GNU:
    _add(f"{_id}-header", _GNU_HEADER.format(what=_what, name=_name, version=_version), _name, f"version {_version} of")
    _add(
        f"{_id}-text",
        f"{_name} Version {_version}, {_day} Everyone is permitted to copy and distribute verbatim copies of this "
        "license document, but changing it is not allowed.",
        f"{_name} Version {_version}, {_day}",
    )
for _version in ("1.1", "2.0"):
    _add(f"MPL-{_version}-text", f"Mozilla Public License Version {_version} 1. Definitions", f"Mozilla Public License Version {_version}", "Definitions")
_add(
    "MPL-2.0-header",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Mozilla Public License, v. 2.0",
)
_add(
    "MPL-1.1-header",
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
    "this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "Mozilla Public License Version 1.1",
)

# ---------------------------------------------------------------- title and first words of long licenses
_add(
    "Apache-2.0-text",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
    "REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, "
    "reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "Apache License Version 2.0",
)
_add(
    "CC0-1.0-text",
    "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE "
    "LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.",
    "CC0 1.0",
)
_add(
    "EPL-2.0-text",
    "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC "
    "LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE "
    "OF THIS AGREEMENT.",
    "Eclipse Public License - v 2.0",
)

# ---------------------------------------------------------------- short notices
def _notice(name: str, text: str, *deciding: str, barred: str = "") -> None:
    """A sentence that puts a work under a license; naming the license alone isn't enough."""
    _add(name, text, "under", *deciding, barred=barred)


_notice("MIT-notice", "Released under the MIT License.", "MIT")
_notice("MIT-id", "Licensed under MIT.", "Licensed under MIT")
_notice("MIT-0-notice", "Released under the MIT-0 License.", "MIT-0")
_notice("ISC-notice", "Released under the ISC License.", "ISC")
_notice("BSD-notice", "Released under the BSD License.", "BSD", barred="clause 2 3 4 simplified new revised modified")
for _n, _also in (("2", "Simplified"), ("3", "New"), ("3", "Revised"), ("3", "Modified")):
    _id = f"BSD-{_n}-Clause"
    _notice(f"{_id}-notice", f"Released under the BSD {_n}-Clause License.", f"BSD {_n}-Clause")
    _notice(f"{_id}-notice-2", f"Released under the {_n}-Clause BSD License.", f"{_n}-Clause BSD")
    _notice(f"{_id}-notice-{_also.lower()}", f"Released under the {_also} BSD License.", f"{_also} BSD")
_notice("BSL-1.0-notice", "Distributed under the Boost Software License, Version 1.0.", "Boost Software License", "Version 1.0")
_notice("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0.", "Apache", "Version 2.0")
_notice("Apache-2.0-name", "Licensed under the Apache License 2.0.", "Apache License 2.0")
_notice("Apache-2.0-name-2", "Licensed under the Apache 2.0 License.", "Apache 2.0")
for _id, _full in (("MPL", "Mozilla Public License"), ("EPL", "Eclipse Public License")):
    for _version in ("1.1" if _id == "MPL" else "1.0", "2.0"):
        _notice(f"{_id}-{_version}-notice", f"Licensed under the {_full}, Version {_version}.", _full, f"Version {_version}")
        _notice(f"{_id}-{_version}-name", f"Licensed under the {_full} {_version}.", f"{_full} {_version}")
        _notice(f"{_id}-{_version}-name-2", f"Licensed under the {_full}, v. {_version}.", _full, f"v. {_version}")
        _notice(f"{_id}-{_version}-id", f"Licensed under the {_id} {_version}.", f"{_id} {_version}")
for _id, _, _name, _version, _ in _GNU:
    _short = _id.split("-")[0]
    _notice(f"{_id}-notice", f"Licensed under the {_name}, version {_version}.", _name, f"version {_version}")
    _notice(f"{_id}-name", f"Licensed under the {_name} v{_version}.", _name, f"v{_version}")
    _notice(f"{_id}-id", f"Licensed under the {_short} v{_version}.", f"{_short} v{_version}")
    _notice(f"{_id}-id-2", f"Licensed under the {_short}v{_version}.", f"{_short}v{_version}")
    _notice(f"{_id}-id-3", f"Licensed under {_id}.", _id)
    _notice(f"{_id}-id-4", f"Licensed under the {_short} version {_version}.", f"{_short} version {_version}")
for _kind, _full in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        _id = f"CC-{_kind}-{_version}"
        _notice(f"{_id}-notice", f"Licensed under CC {_kind} {_version}.", f"CC {_kind} {_version}")
        _notice(
            f"{_id}-name", f"Licensed under a Creative Commons {_full} {_version} License.",
            f"Creative Commons {_full} {_version}",
        )
_notice("CC0-1.0-notice", "Released under CC0 1.0.", "CC0 1.0")
_notice("Unlicense-notice", "Released under the Unlicense.", "the Unlicense")

_SPDX = [
    "MIT", "MIT-0", "ISC", "0BSD", "Zlib", "Unlicense", "BSL-1.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MPL-1.1",
    "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", *(g[0] for g in _GNU),
    *(k.removesuffix("-notice") for k in TEMPLATES if k.startswith("CC-") and k.endswith("-notice")),
]
for _id in _SPDX:
    _add(f"{_id}-spdx", f"SPDX-License-Identifier: {_id}", _id)

# Words right behind the last deciding phrase that make it another license's.
NOT_NEXT = {
    "MIT-id": "0", "MIT-spdx": "0", "LGPL-2.0-id": "1", "LGPL-2.0-id-2": "1", "LGPL-2.0-id-4": "1",
    "BSD-2-Clause-spdx": "patent views first", "BSD-3-Clause-spdx": "clear no attribution lbnl open modification sun",
    "BSD-4-Clause-spdx": "shortened uc",
}
