"""Disguised letters fold to the class that the lexicon has too."""

import pytest

from eventwarden.llm import toxicity

LEXICON = toxicity.Lexicon({"clown": 3.0, "loser": 2.0, "worthless": 2.0, "idiot": 3.0, "bigot": 2.0}, ("class clown",), -3.0, 4.0)


@pytest.mark.parametrize("text, count", [
    ("a c1own", 1), ("10ser", 1), ("worth1ess", 1), ("1d1ot", 1), ("c|own", 1), ("!diot", 1), ("id!ot", 1), ("|oser!", 1), ("8igot", 1),
    ("bi9ot", 1), ("ｉｄｉｏｔ", 1), ("ｃｌｏｗｎ", 1), ("𝐢𝐝𝐢𝐨𝐭", 1), ("shut up!idiot", 1), ("idiot!", 1), ("the c1ass clown!", 0), ("a low|own b", 0), ("", 0)])
def test_disguises(text, count):
    found, table = toxicity.automaton(LEXICON), toxicity.fold_table()
    assert len(toxicity.hits(toxicity.folded(text, table), found)) == count


def test_plain_words_are_found_once_and_folding_twice_changes_nothing():
    found, table = toxicity.automaton(LEXICON), toxicity.fold_table()
    once = toxicity.folded("A Clown, a LOSER; will!ow 1998", table)
    assert toxicity.folded(once, table) == once
    assert sorted(w for _, _, w in toxicity.hits(once, found)) == [2.0, 3.0]
