"""Whole texts and standard headers of known licences: a fixed set, read by the driver."""

from __future__ import annotations

from pathlib import Path

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program. {end}"""
_ENDS = ["If not, see <https://www.gnu.org/licenses/>.", "If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
_GENERAL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
HEADERS = {
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""],
    "MPL-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""],
    **{f"{short}-{version}": [_GNU.format(name=name, version=version.removesuffix(".0"), end=end) for end in _ENDS]
       for short, name, version in (("GPL", _GENERAL, "2.0"), ("GPL", _GENERAL, "3.0"), ("LGPL", _LESSER, "2.1"), ("LGPL", _LESSER, "3.0"), ("AGPL", _AFFERO, "3.0"))},
}


def texts() -> list[tuple[str, str]]:
    """(licence, text) of every whole text and header."""
    whole = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    return whole + [(name, text) for name, found in sorted(HEADERS.items()) for text in found]
