"""Prompts for a describing model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = (
    "After a blank line add one line of 5-10 keywords, separated by commas, in the singular and without hashtags. "
    "Write all of it in {language} only, without a word or letter of another language."
)
PROMPTS = {
    "photos": (
        'The photo lies in the folder "{context}". Folder names often hold a date or an occasion; where the picture says otherwise, the picture is right.\n\n'
        "In 1-3 sentences say what the photo shows: scene, occasion, objects, setting. Name no person, even if the folder does. " + _SHAPE
    ),
    "media": (
        'The file lies in the folder "{context}" of a media library. The folder hints at a topic; guess no date, place or private occasion from it.\n\n'
        "First see what kind of picture it is, then describe it in 1-3 sentences. Chart or diagram: topic and main finding, legible facts alone. "
        "Photograph: scene, objects, setting, no names but of well-known public figures. Painting or illustration: subject, technique, author and title if well known. "
        "Meme: the joke, with its caption.\n\n" + _SHAPE
    ),
}


def prompt(kind: str, context: Column, language: str = "English") -> Column:
    return F.replace(F.replace(F.lit(PROMPTS[kind]), F.lit("{language}"), F.lit(language)), F.lit("{context}"), context)
