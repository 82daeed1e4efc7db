from rowcloak.llm.langid import presence, segments


def test_letters_above_the_first_plane():
    for other in ("\U0001d7d8", "\U0001d11e", "\U000e0100", "\U0001f600", "\U0010fffd"):
        assert segments(other * 3) == []
        assert (presence(segments(f"ab{other}cd")[0]) == presence(segments("ab cd")[0])).all()
    for letter in ("\U00020000", "\U00010428", "\U0001d400", "\U00030000"):
        assert len(segments(letter)) == 1
