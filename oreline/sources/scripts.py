"""Text blobs of sound systems: sound tables, sequences of commands, volume curves, and patch tables of a wavetable card."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from oreline.options import Options, Report
from oreline.sources.audio import words
from oreline.sources.wad import _arrow

# Commands of sequences (without regard to case) and what follows each.
COMMANDS = {
    "play": ("sound",), "playuntildone": ("sound",), "playrepeat": ("sound",), "stopsound": ("sound",), "playtime": ("sound", "number"),
    "delay": ("number",), "volume": ("number",), "delayrand": ("number", "number"), "end": (),
}
GUS_FIELDS = 6  # fixed value: instrument, four mappings by memory size, patch name


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() and int(text) < 2**32 else None


def _tokens(text: str) -> Iterator[str]:
    for line in words(text):
        yield from line


def sound_table(text: str, options: Options = Options()) -> tuple[list[tuple[str, str]], dict[int, str], list[str]]:
    """(pairs of sound and blob, songs by map number, warnings). ``?`` stands for the default sound; songs of map 0 are left out, and
    so are directives that are not known."""
    say, pairs, songs = Report(options), [], {}
    rest = _tokens(text)
    for word in rest:
        if not word.startswith("$"):
            blob = next(rest, None)
            if blob is None:
                say("value_missing", word)
            else:
                pairs.append((word, "DEFAULT" if blob == "?" else blob))
            continue
        what = word[1:].lower()
        if what == "archivepath" and next(rest, None) is None:
            say("value_missing", word)
        elif what == "map":
            number, song = next(rest, None), next(rest, None)
            n = None if number is None else _number(number)
            if number is not None and n is None:
                say("map_number", number)
            elif song is None:
                say("value_missing", word)
            elif n:
                songs[n] = song
    return pairs, songs, say.warnings


def sound_sequences(text: str, options: Options = Options()) -> tuple[list[dict], list[str]]:
    """(sequences: name and commands, warnings). A sequence runs from its ``:name`` to ``end``, the next name or the end of the text; a
    command that cannot be read is left out with what follows it."""
    say, out, current = Report(options), [], None
    rest = _tokens(text)
    for word in rest:
        if word.startswith(":"):
            if current is not None:
                say("sequence_inside", word[1:])
            current = {"name": word[1:], "commands": []}
            out.append(current)
            continue
        if current is None:
            say("command_outside", word)
            continue
        wanted = COMMANDS.get(word.lower())
        if wanted is None:
            say("command_unknown", word)
            continue
        given = [next(rest, None) for _ in wanted]
        values = [g if g is None or w == "sound" else _number(g) for g, w in zip(given, wanted, strict=True)]
        if None in given:
            say("value_missing", word)
        elif None in values:
            say("number", f"{word} {given[values.index(None)]}")
        else:
            current["commands"].append((word.lower(), *values))
            if word.lower() == "end":
                current = None
    if current is not None:
        say("sequence_open", current["name"])
    return out, say.warnings


def sound_curve(data: bytes) -> list[int]:
    """Volume by distance, a byte each; any length will do."""
    return list(data)


def gus_patches(text: str, options: Options = Options()) -> tuple[list[dict], list[str]]:
    """(instrument, mappings, patch) of each line, and warnings; ``#`` begins a comment."""
    say, out = Report(options), []
    for n, line in enumerate(text.split("\n"), 1):
        fields = [f.strip() for f in line.partition("#")[0].split(",")]
        if fields == [""]:
            continue
        numbers = [_number(f) for f in fields[:5]]
        if len(fields) < GUS_FIELDS or None in numbers:
            say("gus_line", str(n))
            continue
        if len(fields) > GUS_FIELDS:
            say.warnings.append(f"gus_extra_fields: {n}")
        out.append({"instrument": numbers[0], "mappings": numbers[1:], "patch": fields[5]})
    return out, say.warnings


def sequence_rows(lumps: DataFrame, options: Options = Options(strict=False)) -> DataFrame:
    """Commands of all sequences in text blobs (path, data): path, sequence, step, command, sound, low, high."""
    out = "path string, sequence string, step int, command string, sound string, low long, high long"
    schema = _arrow(out)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for s in sound_sequences((data or b"").decode("utf-8", "replace"), options)[0]:
                    for i, (name, *values) in enumerate(s["commands"]):
                        sound = next((v for v in values if isinstance(v, str)), None)
                        numbers = [v for v in values if isinstance(v, int)] + [None, None]
                        rows.append((path, s["name"], i, name, sound, numbers[0], numbers[1]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return lumps.select("path", "data").mapInArrow(run, out)


