"""The license templates of operator 9's query: whole texts, long notices and one-line notices, as (name, text)."""

from __future__ import annotations

import os

from tracelake.llm.licenses import TEMPLATES

_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
_GNU = {"GPL": ("General Public", ("1", "2", "3")), "LGPL": ("Lesser General Public", ("2.1", "3")), "LGPL-library": ("Library General Public", ("2",)), "AGPL": ("Affero General Public", ("3",))}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: Ways to name a license in one line, after "under the" or "under".
_NAMES = {
    "MIT": ("MIT License", "MIT Licence", "Expat License"),
    "Apache-2.0": ("Apache License 2.0", "Apache License Version 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache Software License 2.0", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License v2.0", "MPL 2.0"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License Version 1.1"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License Version 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License Version 2.0", "Eclipse Public License v2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0 License", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License Version 1.0"),
    "Zlib": ("zlib License", "zlib libpng License"),
    "WTFPL": ("WTFPL License",),
    "Unlicense": ("Unlicense License",),
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_VERBS = ("licensed", "released", "distributed", "available", "published", "provided")


def _long_gnu():
    for family, (kind, versions) in _GNU.items():
        short = family.split("-")[0]
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            for what in ("program", "library", "software"):
                end = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details."
                head = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation,"
                yield f"{name}-or-later", f"{head} either version {v} of the License, or (at your option) any later version. {end}"
                yield f"{name}-only", f"{head} version {v} of the License. {end}"


def _one_line():
    names = {k: list(v) for k, v in _NAMES.items()}
    for family, (kind, versions) in _GNU.items():
        short = family.split("-")[0]
        for v in versions:
            forms = [f"GNU {kind} License {x}" for x in (f"version {v}", f"v{v}", v)] + [f"GNU {short} {x}" for x in (f"version {v}", f"v{v}", v)] + [f"{short} {x}" for x in (f"version {v}", f"v{v}", f"v{v} License", f"{v} License")] + [f"{short}v{v} License"]
            names.setdefault(f"{short}-{v if '.' in v else v + '.0'}", []).extend(forms)
    for k, words in _CC.items():
        for v in ("2.0", "2.5", "3.0", "4.0"):
            kind = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            names[f"CC-{k}-{v}"] = [f"Creative Commons {words} {v} {kind} License", f"Creative Commons {words} {v} License", f"CC {k} {v}"]
    for name, forms in names.items():
        for form in forms:
            for verb in _VERBS:
                for way in ("under", "under the", "under a", "under the terms of the"):
                    yield f"{name}-notice", f"{verb} {way} {form}"


def templates() -> list[tuple[str, str]]:
    out = list(TEMPLATES.items())
    for f in sorted(os.listdir(_FOLDER)):
        with open(os.path.join(_FOLDER, f), encoding="utf-8") as text:
            name = f[:-4]
            out.append((name if "." in name else name + ".0", text.read()))
    out += [("MIT", f"{TEMPLATES['MIT']} {_AS_IS}"), ("BSD-2-Clause", f"{_BSD} {_BSD_END}"), ("BSD-3-Clause", f"{_BSD} {_BSD_3} {_BSD_END}"), ("BSD-3-Clause", f"{_BSD} {_BSD_3}")]
    return out + list(_long_gnu()) + list(dict.fromkeys(_one_line()))
