"""Packet analytics on Spark: captures in, typed rows of decoded protocol fields out."""

from packetloom.plans.config import ParseConfig
from packetloom.plans.decode import decode

__all__ = ["ParseConfig", "decode"]
