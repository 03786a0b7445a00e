"""No text, however long and odd, takes an operator more than a time that grows with its length."""

import time

import pytest

from lodestone.llm import layout, lexers, quality, secrets, splitting

N = 60_000
ODD = ["a" * N, '"' * N, "{" * N, "=" * N, "password=" * (N // 9), "x\n" * (N // 2), " " * N, "\\" * N, "-----BEGIN PRIVATE KEY-----" * (N // 27), "/*" * (N // 2), "`${" * (N // 3), "a,b;" * (N // 4), "日本" * (N // 2), "0.1," * (N // 4), "://a:b" * (N // 6), 'key":' * (N // 5), "<a " * (N // 3), "a.b" * (N // 3), "- a\n" * (N // 4), "[a]\n" * (N // 4),
       'a = "b\\"c"\n' * (N // 11), "eyJ" * (N // 3), "secret" * (N // 6), "password = '" + "a b " * (N // 4), "-----BEGIN PRIVATE KEY-----\n" + "\\n+" * (N // 3), '"""' + "a\n" * (N // 2), "env.get(" * (N // 8), "b" * N + "password='" + "c" * N, "api_key = (" + "'ab'\n" * (N // 5)]
RUNS = {
    "secrets": lambda t: secrets.redact(t), "layout": lambda t: layout.layout_stats("a.py", t), "quality": quality.text_stats, "splitting": splitting.split_text,
    "python": lexers.check_python, "javascript": lexers.check_js, "typescript": lambda t: lexers.check_js(t, True), "toml": lexers.check_toml,
}


@pytest.mark.parametrize("name", RUNS)
def test_time_grows_with_the_length(name):
    for text in ODD:
        start = time.time()
        RUNS[name](text)
        assert time.time() - start < 8, text[:20]
