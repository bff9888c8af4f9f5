"""A profile counts the words of a text once, and gives what plain Python gives."""

import random
import re

from docloom.functions import fixed, profile
from docloom.plans import catalog


def test_words_are_counted_once(spark, tmp_path):
    spark.createDataFrame([(1, "Some words.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.quality_flags(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\S+ ") == 0 and plan.count(fixed.WORD) == 1


def test_profile_equals_python(spark):
    r = random.Random(9)
    parts = ["The", "rhythm", "bcd", "pdf", "a@b.co", "x@", "http://q.r/s", "https:", "www.z", "www", "It's", "é", "İx", "A-b", "\n", "  ", "q", "HOUSE OVERSIGHT 01234", "z9", "THE"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(200)] + [None, "", " "]
    rows = profile.profile(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    for x in rows:
        if x.text is None:
            assert x.n_words is None and x.common_word_ratio is None and x.no_vowel_type_ratio is None
            continue
        body = re.sub("(?i)" + fixed.STAMP, " ", x.text)
        prose = re.sub(fixed.EMAIL, " ", re.sub(fixed.URL, " ", body), flags=re.ASCII)
        words = [w.lower() for w in re.findall(fixed.WORD, prose)]
        kinds = set(words)
        bare = lambda w: len(w) >= 3 and not re.search("[aeiouy]", w) and w not in fixed.VOWELLESS_WORDS
        assert (x.n_words, x.n_unique_words) == (len(words), len(kinds)), x.text
        assert abs(x.common_word_ratio - sum(w in fixed.COMMON_WORDS for w in words) / max(1, len(words))) < 1e-9
        assert abs(x.no_vowel_type_ratio - sum(map(bare, kinds)) / max(1, len(kinds))) < 1e-9
        assert abs(x.mean_word_len - sum(map(len, words)) / max(1, len(words))) < 1e-9
