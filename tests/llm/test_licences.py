"""Licence texts against a canonical form restated here, which shares nothing with the library's."""

import glob
import os
import re
import textwrap

import duckdb
import pytest

from quillspark.llm import licenses

FOLDER = "/usr/share/common-licenses"
COMMON = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def words(text):
    """Letters and digits only, lower case, without lines that open with 'copyright'."""
    lines = [x for x in text.lower().splitlines() if not x.strip().startswith("copyright (c)")]
    return "".join(c if c.isalnum() else " " for c in " ".join(lines)).split()


@pytest.mark.parametrize("name", COMMON)
def test_common_licences(name):
    path = os.path.join(FOLDER, name)
    if not os.path.exists(path):
        pytest.skip("not on this machine")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    known = licenses.known_digests()
    head, _, rest = text.partition("END OF TERMS AND CONDITIONS")
    forms = [text, text.upper(), text.replace("\n", "\r\n"), re.sub(r"(?m)^", "# ", text), "\n\n" + text + "\n", text.replace("'", "’").replace('"', "”").replace(";", ","), *([head] if rest else [])]
    assert [known.get(licenses.digest(x)) for x in forms] == [COMMON[name]] * len(forms)
    # any change of a word is another text
    w = words(text)
    if COMMON[name] in licenses.TEXTS and name != "BSD":
        assert words(licenses.TEXTS[COMMON[name]])[:200] == w[:200]
    middle = text.rindex(" ", 0, len(text) // 2)
    assert known.get(licenses.digest(text[:middle] + " unless agreed" + text[middle:])) is None
    assert known.get(licenses.digest(text[: len(text) // 3])) is None


@pytest.mark.parametrize("holder", ["Google Inc.", "the University of California, Berkeley", "Jane Q. Public"])
def test_names_of_holders(holder):
    t = licenses.TEXTS["BSD-3-Clause"].replace("name of the copyright holder nor", f"name of {holder} nor").replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR").replace("THE COPYRIGHT HOLDERS AND", holder.upper() + " AND")
    t = f"Copyright (c) 2001, {holder}\nAll rights reserved.\n\n" + textwrap.fill(t, 70)
    assert licenses.known_digests().get(licenses.digest(t)) == "BSD-3-Clause"
    # who may be sued is no name to be left out elsewhere
    assert licenses.known_digests().get(licenses.digest(t.replace("without specific prior", "without prior"))) is None


def test_publisher_address_and_notice():
    known, gpl = licenses.known_digests(), licenses.TEXTS["GPL-2.0"]
    assert known[licenses.digest(gpl.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"))] == "GPL-2.0"
    assert known[licenses.digest("Copyright 2014 Someone\n\n" + licenses.ALSO["Apache-2.0"][0])] == "Apache-2.0"
    assert known.get(licenses.digest("https://example.org Licensed")) is None and known.get(licenses.digest("")) is None


def test_long_first_line_is_no_title():
    assert not licenses._titled("MIT License " + "x " * 100) and licenses._titled(" * The MIT License (MIT)" + " " * 200)


def test_installed_single_licences():
    """Files that hold one licence as published, by their own first words, told apart from notices and collections: at least 0.9 are found."""
    site, known = os.path.dirname(os.path.dirname(duckdb.__file__)), licenses.known_digests()
    ends = {"MIT": "or other dealings in the software", "BSD": "even if advised of the possibility of such damage", "Apache": "limitations under the license"}
    begins = {"MIT": r"permission is hereby granted free of charge", "BSD": r"redistribution and use in source and binary forms", "Apache": r"apache license version 2 0 january 2004"}
    single = found = 0
    for path in sorted({f for p in ("LICEN*", "COPYING*") for f in glob.glob(f"{site}/**/{p}", recursive=True) if os.path.isfile(f)}):
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read()
        plain = " ".join(words(text))
        for k in begins:
            if re.match(rf"(?:\w+ ){{0,12}}{begins[k]}", plain) and plain.endswith(ends[k]) and sum(plain.count(b) for b in begins.values()) == 1:
                single += 1
                found += licenses.digest(text) in known
    if single < 10:
        pytest.skip("too few packages")
    assert found >= 0.9 * single, (found, single)
