import pytest

from lectern.config import Settings, read_env_file


def test_settings(tmp_path):
    assert Settings.load({}) == Settings()
    assert Settings.load({"RATE_LIMIT_PER_MINUTE": "7", "SPEND_CAP_USD": "0.5"}).spend_cap_usd == 0.5
    (tmp_path / ".env").write_text("# note\nA=1\nB = 'x y'\nbroken\n")
    assert read_env_file(str(tmp_path / ".env")) == {"A": "1", "B": "x y"} and read_env_file(str(tmp_path / "none")) == {}


@pytest.mark.parametrize("bad", [{"SPEND_CAP_USD": "nan"}, {"SPEND_CAP_USD": "-1"}, {"RATE_LIMIT_PER_MINUTE": "x"}, {"RATE_LIMIT_PER_MINUTE": "0"}, {"COLLECTION": " "}])
def test_bad_settings_are_named(bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        Settings.load(bad)
