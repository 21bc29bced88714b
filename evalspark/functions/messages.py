"""Multi-modal messages: ``array<struct<type, value>>`` columns and the prompts built from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions import text as T

# File name endings and the message type they stand for.
MEDIA_SUFFIXES = {
    "image": ["jpg", "jpeg", "jpe", "png", "gif", "bmp", "tif", "tiff", "svg", "webp", "ico"],
    "video": ["mp4", "m1v", "mpeg", "mpg", "mpe", "mpa", "webm", "mov", "qt", "avi", "movie"],
}


def part(kind: str | Column, value: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), T.col(value).alias("value"))


def image_parts(images: Column) -> Column:
    return F.transform(images, lambda x: part("image", x))


def base_message(images: Column | None, question: Column | str) -> Column:
    """All images, then the question."""
    tail = F.array(part("text", question))
    return tail if images is None else F.concat(image_parts(images), tail)


def option_lines(options: Mapping[str, Column | str], end: str = "\n") -> Column:
    lines = [F.concat(F.lit(f"{k}. "), T.col(v), F.lit(end)) for k, v in options.items()]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in lines])


def has_options(options: Mapping[str, Column | str]) -> Column:
    return F.coalesce(*[T.col(v) for v in options.values()]).isNotNull()


def mcq_text(
    question: Column | str,
    options: Mapping[str, Column | str],
    hint: Column | str | None = None,
    *,
    header: str = "Options:\n",
    question_label: str = "Question: ",
    instruction: str | Column = K.SELECT_OPTION,
) -> Column:
    """Hint, question and options lines, then the instruction when there are options."""
    instruction = F.lit(instruction) if isinstance(instruction, str) else instruction
    hint_line = F.lit("") if hint is None else F.coalesce(F.concat(F.lit("Hint: "), T.col(hint), F.lit("\n")), F.lit(""))
    block = F.concat(F.lit(header), option_lines(options), instruction)
    return F.concat(
        hint_line, F.lit(question_label), T.col(question), F.lit("\n"), F.when(has_options(options), block).otherwise("")
    )


def multi_image_text(question: Column | str, options: Mapping[str, Column | str]) -> Column:
    """Question, options joined by newlines and the letter instruction."""
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{k}. "), T.col(v)) for k, v in options.items()]))
    block = F.concat(F.array_join(lines, "\n"), F.lit(K.LETTER_ONLY))
    return F.concat(T.col(question), F.lit("\n"), F.when(F.size(lines) > 0, block).otherwise(""))


def numbered_images(images: Column, text: Column | str) -> Column:
    """Put image N where the text says ``<image N>`` (one digit); unchanged when it never does."""
    text = T.col(text)
    pieces = F.split(text, "<image ")
    inner = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda s: F.array(
            part("image", F.get(images, F.substring(s, 1, 1).try_cast("int") - 1)),
            part("text", F.substr(s, F.lit(3))),
        ),
    )
    woven = F.concat(F.array(part("text", F.get(pieces, F.lit(0)))), F.flatten(inner))
    return F.when(F.size(pieces) == 1, base_message(images, text)).otherwise(woven)


def ordered_images(images: Column, text: Column | str, tag: str = "<image>") -> Column:
    """Put the next image at every tag; empty text pieces are dropped."""
    pieces = F.split(T.col(text), tag)

    def weave(s: Column, i: Column) -> Column:
        image = F.when((i > 0) & (i <= F.size(images)), part("image", F.get(images, i - 1)))
        return F.array_compact(F.array(image, F.when(F.length(s) > 0, part("text", s))))

    return F.flatten(F.transform(pieces, weave))


def turn_content(text: Column | str, images: Column, first_image: Column) -> Column:
    """One turn of a dialogue whose tags take the images from position ``first_image`` on."""
    text = T.col(text)
    tags = F.size(F.split(text, K.IMAGE_HERE)) - 1
    mine = F.slice(images, first_image + 1, tags)
    return F.when(tags == 0, F.array(part("text", text))).otherwise(ordered_images(mine, text, K.IMAGE_HERE))


def dialogue(questions: Column, answers: Column | None, images: Column) -> Column:
    """Alternating user and assistant turns of list-valued question and answer columns."""
    counts = F.transform(questions, lambda q: F.size(F.split(q, K.IMAGE_HERE)) - 1)
    answers = F.transform(questions, lambda q: F.lit("")) if answers is None else answers

    def turn(q: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, x: a + x)
        user = F.struct(F.lit("user").alias("role"), turn_content(q, images, before).alias("content"))
        reply = F.array(part("text", F.get(answers, i)))
        return F.array(user, F.struct(F.lit("assistant").alias("role"), reply.alias("content")))

    return F.flatten(F.transform(questions, turn))


def real_world_text(question: Column | str, options: Column | str, language: str = "en") -> Column:
    return F.concat(T.col(question), F.lit(" "), T.col(options), F.lit("\n" + K.REAL_WORLD_INSTRUCTION[language]))


def table_text(split: Column | str, question: Column | str, templates: Mapping[str, str]) -> Column:
    """Wrap a question in the template of its split (``{question}`` marks the slot)."""
    split, question = T.col(split), T.col(question)
    out = question
    for name, template in templates.items():
        before, after = template.split("{question}")
        out = F.when(split == name, F.concat(F.lit(before), question, F.lit(after))).otherwise(out)
    return out


def video_message(
    system: str, frames: Column | None, video: Column | None, frame_text: Column | str, question: Column | str
) -> Column:
    """System text, frames or the video, frame text, then the question."""
    frame_text = F.lit(frame_text) if isinstance(frame_text, str) else frame_text
    media = F.array(part("video", video)) if frames is None else image_parts(frames)
    ask = F.concat(F.lit("Question: "), T.col(question), F.lit("\nAnswer: "))
    return F.concat(F.array(part("text", F.lit(system))), media, F.array(part("text", frame_text), part("text", ask)))


def pack_text(questions: Column) -> Column:
    """All questions of a video (``map<index, question>``) as one JSON object to be answered in kind."""
    return F.concat(F.lit("Questions: \n"), F.to_json(questions), F.lit("\nAnswers: \n"))


def media_type(c: Column | str) -> Column:
    """``image``/``video`` by file name ending, ``text`` for anything else."""
    ending = F.lower(F.regexp_extract(T.col(c), "^\\S*\\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text")
    for kind, endings in MEDIA_SUFFIXES.items():
        out = F.when(ending.isin(endings), kind).otherwise(out)
    return out


def as_message(items: Column) -> Column:
    """An array of plain strings as message parts."""
    return F.transform(items, lambda s: part(media_type(s), s))


def flat_prompt(message: Column) -> tuple[Column, Column]:
    """(prompt, image) for models that take one text and one image."""
    images = F.filter(message, lambda m: m["type"] == "image")
    texts = F.transform(F.filter(message, lambda m: m["type"] == "text"), lambda m: m["value"])
    marked = F.transform(message, lambda m: F.when(m["type"] == "text", m["value"]).otherwise("<image>"))
    prompt = F.array_join(F.when(F.size(images) > 1, marked).otherwise(texts), "\n")
    return prompt, F.get(images, F.lit(0))["value"]


def flat_video_prompt(message: Column) -> tuple[Column, Column]:
    """(prompt, video) for models that take one text and one video."""
    texts = F.transform(F.filter(message, lambda m: m["type"] == "text"), lambda m: m["value"])
    videos = F.filter(message, lambda m: m["type"] == "video")
    return F.array_join(texts, "\n"), F.get(videos, F.lit(0))["value"]


def as_text_log(message: Column) -> Column:
    """Message on one line, for logs and comparisons."""
    return F.array_join(F.transform(message, lambda m: F.concat(m["type"], F.lit("="), F.coalesce(m["value"], F.lit("?")))), " | ")


def drop_oldest_turns(turns: Column, size_of, budget: int) -> Column:
    """Suffix of a dialogue that fits a budget and starts with a user turn.

    Oldest turns go first, then every further turn up to the next ``user`` turn, as long as the rest is
    too big.  ``size_of`` gives the size of one turn.
    """
    sizes = F.transform(turns, size_of)
    starts = F.transform(
        turns,
        lambda t, i: F.struct(
            ((t["role"] == "user") | (i == 0)).alias("ok"),
            F.aggregate(F.slice(sizes, i + 1, F.size(sizes)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("left"),
            (i + 1).alias("at"),
        ),
    )
    fitting = F.filter(starts, lambda s: s["ok"] & (s["left"] <= budget))
    first = F.get(fitting, F.lit(0))["at"]
    return F.when(first.isNotNull(), F.slice(turns, first, F.size(turns))).otherwise(F.slice(turns, 1, 0))
