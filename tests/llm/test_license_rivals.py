"""Licenses that differ by a word, and texts with many places."""

import time

import pytest

from heliograde.llm import licenses


def found(text):
    return set(licenses.scan(text, licenses.Index(licenses.TEMPLATES, {}), licenses.PHRASES)[5].split(",")) - {""}


@pytest.mark.parametrize("label, text", licenses.TEMPLATES)
def test_each_template_names_its_own_license_alone(label, text):
    assert found(text) == {label} and found(f"Some words. {text.capitalize()}. And others follow, which say this is no work of that kind.") == {label}


@pytest.mark.parametrize("label, text", licenses.TEMPLATES)
def test_each_template_beside_each_other(label, text):
    for other, more in licenses.TEMPLATES:
        assert found(f"{text} and for the other part {more}") == {label, other}


def test_known_notices():
    assert found("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3"}
    assert found("This work is licensed under the GNU Affero General Public License, version 3.") == {"agpl-3"}
    assert found("Work licensed under a Creative Commons Attribution 4.0 International License") == set() or found("This work is licensed under a Creative Commons Attribution 4.0 International License") == {"cc-by"}
    assert found("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License") == {"cc-by-sa"}


def test_many_places_in_linear_time():
    index = licenses.Index(licenses.TEMPLATES, {}, 0.9)
    text = "under the MIT license " * 100_000
    t = time.time()
    got = licenses.scan(text, index, licenses.PHRASES)
    assert got[:4] == (400_000, 100_000, 0, 399_996) and time.time() - t < 10
