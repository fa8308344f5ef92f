"""Texts of well-known licenses and the notices by which files declare them."""

from pathlib import Path

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
    "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
    "of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along "
    "with this program. If not, see <https://www.gnu.org/licenses/>."
)

#: Creative Commons licenses with a choice of terms: short name and title. Versions before 4.0 say NoDerivs.
_CC_TERMS = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_CC_VERSIONS = (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))


def _cc_notices() -> dict[str, str]:
    """The sentences that name a Creative Commons license by its short name or title, for each choice of terms and version."""
    out = {}
    for terms, title in _CC_TERMS:
        for version, scope in _CC_VERSIONS:
            titled = f"Creative Commons {title if version == '4.0' else title.replace('NoDerivatives', 'NoDerivs')} {version}"
            forms = {
                "short": f"CC {terms} {version}", "short a": f"a CC {terms} {version} License", "short the": f"the CC {terms} {version} License",
                "titled": f"{titled} {scope}", "titled a": f"a {titled} {scope} License", "titled the": f"the {titled} {scope} License",
                "unscoped": titled, "unscoped a": f"a {titled} License", "unscoped the": f"the {titled} License",
            }
            for form, named in forms.items():
                out[f"CC-{terms}-{version} {form} notice"] = f"Licensed under {named}."
                # The form that Creative Commons itself proposes is the plain notice.
                out[f"CC-{terms}-{version} {'' if form == 'titled a' else f'{form} work '}notice"] = f"This work is licensed under {named}."
    return out


def _whole_texts() -> dict[str, str]:
    """The long licenses of the folder ``texts``, each also without the instructions that follow its terms."""
    out = {}
    for path in sorted((Path(__file__).parent / "texts").glob("*.txt")):
        out[path.stem] = text = path.read_text("utf-8")
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        if rest.strip():
            out[f"{path.stem}, terms"] = terms + end
            out[f"{path.stem}, terms without end"] = terms
    return out


#: Name of the license and text; names with "notice" are declarations, the others whole licenses.
KNOWN = {
    "MIT": _MIT_GRANT,
    "MIT, titled": "MIT License\n\n" + _MIT_GRANT,
    "MIT, titled The": "The MIT License (MIT)\n\n" + _MIT_GRANT,
    "ISC": _ISC_GRANT + "\n\n" + _ISC_TAIL,
    "ISC, titled": "ISC License\n\n" + _ISC_GRANT + "\n\n" + _ISC_TAIL,
    "0BSD": _ISC_GRANT.split(", provided")[0] + ".\n\n" + _ISC_TAIL,
    "BSD-2-Clause": _BSD_GRANT + _BSD_1 + _BSD_2 + _BSD_TAIL,
    "BSD-2-Clause, titled": "BSD 2-Clause License\n\n" + _BSD_GRANT + _BSD_1 + _BSD_2 + _BSD_TAIL,
    "BSD-3-Clause": _BSD_GRANT + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL,
    "BSD-3-Clause, titled": "BSD 3-Clause License\n\n" + _BSD_GRANT + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_TAIL,
    "Zlib": _ZLIB,
    "Unlicense": _UNLICENSE,
    "Apache-2.0 notice": _APACHE_NOTICE,
    "Apache-2.0 short notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": _GPL_NOTICE,
    "GPL-3.0 short notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT short notice": "Released under the MIT License.",
    "MIT licensed notice": "Licensed under the MIT License.",
    "BSD short notice": "Licensed under the BSD License.",
    "CC0-1.0 notice": "This work is released into the public domain under the CC0 1.0 license.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    **_cc_notices(),
    **_whole_texts(),
}
