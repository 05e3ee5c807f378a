"""Text and number rules by hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import numeric as N
from gradeloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


CASES = [
    (lambda: T.normalize_text(F.lit("  \\boxed{a {b} c}  ")), "a {b} c"),
    (lambda: T.normalize_text(F.lit("\\boxed{open")), "\\boxed{open"),
    (lambda: T.normalize_text(F.lit("<think>x</think> 3 × 4 − 5\\%")), "x 3 * 4 - 5%"),
    (lambda: T.normalize_text(F.lit("ﬁne １２")), "fine 12"),
    (lambda: T.normalize_text(F.lit(None).cast("string")), ""),
    (lambda: T.normalize_open(F.lit('"The Bridge".')), 'the bridge"'),
    (lambda: T.normalize_open(F.lit("`Yes`")), "yes"),
    (lambda: F.array_join(T.question_letters(F.lit("x (A) 1 (B) 2 (D) 4")), ""), "AB"),
    (lambda: F.array_join(T.question_letters(F.lit("Pick\nA. one\nB: two C) three")), ""), "ABC"),
    (lambda: F.array_join(T.choices_to_letters(F.array(F.lit("0"), F.lit("3"))), ""), "AB"),
    (lambda: F.array_join(T.choices_to_letters(F.array(F.lit("b"), F.lit("C"))), ""), "BC"),
    (lambda: T.strip_letter_prefix(F.lit("B. left"), F.lit("B")), "left"),
    (lambda: T.strip_letter_prefix(F.lit("B. left"), F.lit("A")), "B. left"),
    (lambda: F.array_join(T.gt_letters(F.lit("C and A"), F.lit(False)), ""), "AC"),
    (lambda: T.gt_letters(F.lit("BED"), F.lit(False)), None),
    (lambda: F.array_join(T.gt_letters(F.lit("(D)"), F.lit(False)), ""), "D"),
    (lambda: T.gt_letters(F.lit("D"), F.lit(True)), None),
    (lambda: T.parse_number(F.lit("24%")), 0.24),
    (lambda: T.parse_number(F.lit("1,200.5")), 1200.5),
    (lambda: T.parse_number(F.lit("1_000")), 1000.0),
    (lambda: T.parse_number(F.lit("5d")), None),
    (lambda: T.parse_number(F.lit("0x1p3")), None),
    (lambda: T.parse_number(F.lit("-1e3")), -1000.0),
    (lambda: T.extract_yes_no(F.lit("yes and no")), None),
    (lambda: T.extract_yes_no(F.lit("I know. Yes")), "yes"),
    (lambda: T.infer_option(F.lit("A teddy bear"), T.letters(4)), "A"),
    (lambda: T.infer_option(F.lit("I say A or B"), T.letters(4)), None),
    (lambda: T.option_strict(F.lit("A teddy bear"), T.letters(4)), None),
    (lambda: T.option_strict(F.lit("b"), T.letters(4)), "B"),
    (lambda: T.option_strict(F.lit("the answer is a teddy bear"), T.letters(4)), None),
    (lambda: F.array_join(T.letters_of_plain(F.lit("BD"), T.letters(4)), ""), "BD"),
    (lambda: T.letters_of_plain(F.lit("B, B"), T.letters(4)), None),
    (lambda: F.array_join(T.split_chunks(F.lit("a <image> b<video>")), "|"), "a |<image>| b|<video>"),
    (lambda: T.question_with_media(F.lit("see <image 1> and <image 2>"), F.lit(2)), "see <image> and <image>"),
    (lambda: T.question_with_media(F.lit("see <image 1>"), F.lit(2)), "<image><image>see"),
    (lambda: F.array_join(T.media_paths(F.lit(None).cast("string"), F.lit("['a.png', 'b.png']")), "|"), "a.png|b.png"),
    (lambda: T.is_video(F.lit("x/y.MP4?sig=1")), True),
    (lambda: T.video_choice(F.lit("The best answer is B.")), "B"),
    (lambda: T.video_choice(F.lit("one two three four five six seven eight nine ten eleven")), ""),
    (lambda: T.choice_index(F.lit("answer: (C)"), F.array(F.lit("x"))), 2),
    (lambda: T.choice_index(F.lit("a red ball."), F.array(F.lit("blue."), F.lit("red."))), 1),
    (lambda: T.longest_repeat(F.lit("abcxabc")), "abc"),
    (lambda: N.numbers_match(F.lit(0.01), F.lit(0.0), rel_tol=0.05), False),
    (lambda: N.numbers_match(F.lit(float("nan")), F.lit(float("nan"))), False),
    (lambda: N.numbers_match(F.lit(0.01), F.lit(0.0), abs_tol=0.05), True),
    (lambda: F.round(N.vqa_consensus(F.lit("a b"), F.array(*[F.lit("a b")] * 3, *[F.lit("x")] * 7)), 6), 0.9),
    (lambda: N.vqa_consensus(F.lit("x"), F.array(F.lit("x"))), None),
    (lambda: N.anls(F.lit("abcd"), F.array(F.lit("abcx"))), 0.75),
    (lambda: N.anls(F.lit("ab"), F.array(F.lit("xy")), 0.0), 0.0),
    (lambda: N.evalai_process(F.lit("The two dogs, isnt it?")), "2 dogs isn't it"),
    (lambda: N.best_choice(T.letters(3), F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))), "B"),
    (lambda: F.array_join(N.uniform_frames(F.lit(5), 3).cast("array<string>"), ","), "0,2,4"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(spark, i):
    make, want = CASES[i]
    assert one(spark, make()) == want
