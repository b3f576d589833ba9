"""DNS messages: header and questions, names with compression, as one expression.

Names: labels of letters, digits and hyphens; pointers lead strictly backwards; at most as
many steps as the message has bytes. Any fault makes the whole message NULL. A message that
asks one question, by a name without pointers and of labels under 45 bytes, is read by one
pattern; all others are walked label by label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.bytes import bits, raw, u8, u16, u32, word

HEADER = ("transaction_id", "flags", "questions", "answers", "authorities", "additionals")


def dns_header(m: Column) -> Column:
    head, rest = word(m, 0), u32(m, 8)
    of = [bits(head, 48 - 16 * i, 16) for i in range(4)] + [bits(rest, 16, 16), bits(rest, 0, 16)]
    return F.struct(*[x.cast("int").alias(n) for x, n in zip(of, HEADER)])


def _plain_pattern() -> str:
    """A name in hex digits whose labels are under 45 bytes, with its end, before 4 bytes more.
    Such lengths are no byte that a label may hold."""
    letter = "(?:2D|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])"
    return "^((?:" + "|".join(f"{n:02X}{letter}{{{n}}}" for n in range(1, 45)) + ")*+00).{8}"


def plain_name(m: Column) -> Column:
    """Hex digits of the name of a message's only question if the pattern reads it, else ''."""
    return F.when((F.length(m) >= 17) & (raw(m, 4, 2) == F.lit(bytearray(b"\0\1"))), F.regexp_extract(F.hex(raw(m, 12, 300)), _plain_pattern(), 1)).otherwise("")


def _plain(m: Column, name: Column) -> Column:
    """(message, error) of a message whose name the pattern has read."""
    text = F.translate(F.decode(F.unhex(name), "ISO-8859-1"), "".join(map(chr, range(1, 45))), "." * 44)
    at = F.shiftright(F.length(name), 1) + 12
    asked = F.struct(F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))).alias("qname"), u16(m, at).alias("qtype"), u16(m, at + 2).alias("qclass"))
    return F.struct(F.struct(dns_header(m).alias("header"), F.array(asked).alias("questions")).alias("message"), F.lit(None).cast("string").alias("error"))


def _name(m: Column, start: Column) -> Column:
    """(name, resume, error): error is NULL or the kind of the fault."""
    none, size = F.lit(None), F.length(m)

    def state(at, name, resume, error=None, done=False) -> Column:
        return F.struct(at.cast("int").alias("at"), name.alias("name"), resume.cast("int").alias("resume"), (none if error is None else F.lit(error)).cast("string").alias("error"), F.lit(done).alias("done"))

    def step(s: Column, i: Column) -> Column:
        at, name, resume = s["at"], s["name"], s["resume"]
        length = u8(m, at)
        target = F.when(at + 1 < size, length.bitwiseAND(0x3F) * 256 + u8(m, at + 1))
        label = F.decode(raw(m, at + 1, length), "ISO-8859-1")
        longer = F.when(name == "", label).otherwise(F.concat(name, F.lit("."), label))
        return (
            F.when(s["done"], s)
            .when(i > size + 1, state(at, name, resume, "MalformedPacket", True))
            .when(at >= size, state(at, name, resume, "InvalidLength", True))
            .when(length == 0, state(at, name, F.coalesce(resume, at + 1), None, True))
            .when((length > 63) & (length < 0xC0), state(at, name, resume, "MalformedPacket", True))
            .when((length >= 0xC0) & target.isNull(), state(at, name, resume, "InvalidLength", True))
            .when((length >= 0xC0) & (target >= at), state(at, name, resume, "MalformedPacket", True))
            .when(length >= 0xC0, state(target, name, F.coalesce(resume, at + 2)))
            .when(at + 1 + length > size, state(at, name, resume, "InvalidLength", True))
            .when(label.rlike("[^A-Za-z0-9-]"), state(at, name, resume, "MalformedPacket", True))
            .otherwise(state(at + 1 + length, longer, resume))
        )

    # one step more than may be taken tells a name that never ends
    return F.aggregate(F.sequence(F.lit(1), size + 2), state(start, F.lit(""), none), step)


def dns_parsed(m: Column, name: Column | None = None) -> Column:
    """(message, error) of the bytes of a message. name: its ``plain_name``, if worked out."""
    if name is None:
        return F.get(F.transform(F.array(plain_name(m)), lambda n: dns_parsed(m, n)), F.lit(0))
    return F.when(name != "", _plain(m, name)).otherwise(_walked(m))


def _walked(m: Column) -> Column:
    size, count = F.length(m), u16(m, 4)
    empty = F.array().cast("array<struct<qname: string, qtype: int, qclass: int>>")
    first = F.struct(F.lit(12).alias("at"), empty.alias("questions"), F.lit(None).cast("string").alias("error"))

    def question(s: Column, _: Column) -> Column:
        def read(n: Column) -> Column:
            at = n["resume"]
            asked = F.struct(n["name"].alias("qname"), u16(m, at).alias("qtype"), u16(m, at + 2).alias("qclass"))
            error = F.coalesce(n["error"], F.when(at + 4 > size, "InvalidLength"))
            return F.when(error.isNull(), F.struct((at + 4).alias("at"), F.concat(s["questions"], F.array(asked)).alias("questions"), error.alias("error"))).otherwise(F.struct(s["at"].alias("at"), s["questions"].alias("questions"), error.alias("error")))

        return F.when(s["error"].isNotNull(), s).otherwise(F.get(F.transform(F.array(_name(m, s["at"])), read), F.lit(0)))

    # a question takes 5 bytes at least: one more than fit is sure to fail
    most = F.least(count, F.floor((size - 12) / 5).cast("int") + 1)
    walked = F.when(count > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), first, question)).otherwise(first)
    short = F.struct(F.lit(12).alias("at"), empty.alias("questions"), F.lit("InvalidLength").alias("error"))
    walked = F.when(size < 12, short).otherwise(walked)
    message = lambda w: F.struct(F.when(w["error"].isNull(), F.struct(dns_header(m).alias("header"), w["questions"].alias("questions"))).alias("message"), w["error"].alias("error"))
    return F.get(F.transform(F.array(walked), message), F.lit(0))


def dns(m: Column, name: Column | None = None) -> Column:
    """The message, or NULL."""
    return dns_parsed(m, name)["message"]
