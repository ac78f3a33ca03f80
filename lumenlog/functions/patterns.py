"""Patterns and tables of the detection and parsing rules."""

from __future__ import annotations

# Detection rules find exactly what these patterns find.
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?<!\d)(?:\+86[-\s]?)?1[3-9]\d[-\s]?\d{4}[-\s]?\d{4}(?!\d)"
ID_CARD = r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"
BANK_CARD = r"\b\d{16,19}\b"
TOKEN = r"""(?:token|access_token|refresh_token|api_key|secret|password|passwd|pwd)[\s:=]+["']?([^\s&"',]+)["']?"""
SESSION = r"""(?:session_id|sessionid|PHPSESSID|JSESSIONID)[\s:=]+["']?([^\s&"',]+)["']?"""
COOKIE = r"(?:Set-Cookie|Cookie):\s*([^\n]+)"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
ID_CARD_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_CARD_CHECK_CODES = ["1", "0", "X", "9", "8", "7", "6", "5", "4", "3", "2"]
# Formats that lines are parsed by.
LEVEL = r"\[(DEBUG|TRACE|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\]|\b(DEBUG|TRACE|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\b"
ACCESS = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d+)\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"$'
SYSLOG_3164 = r"^<(\d+)>([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\s\[]+)(?:\[(\d+)\])?:\s*(.*)$"
SYSLOG_5424 = r"^<(\d+)>(\d+)\s+(-|(?:\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})))\s+(-|\S+)\s+(-|\S+)\s+(-|\S+)\s+(-|\S+)\s+(-|\[.*?\])\s*(.*)$"
PLAIN = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(?:\[([A-Z]+)\]|\b([A-Z]+)\b)\s+(.*)$"
STAMP_DASHED = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
STAMP_SLASHED = r"\d{4}/\d{2}/\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?"
STAMP_ACCESS = r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s*[+-]\d{4}"
STAMP_SYSLOG = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
STAMP_MAIL = r"[A-Z][a-z]{2},\s+\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}\s+\d{2}:\d{2}:\d{2}\s+[+-]\d{4}"
STAMP_ANY = "|".join((STAMP_DASHED, STAMP_SLASHED, STAMP_ACCESS, STAMP_SYSLOG, STAMP_MAIL))
LEVEL_NAMES = {"DEBUG": "DEBUG", "TRACE": "TRACE", "INFO": "INFO", "WARN": "WARN", "WARNING": "WARN", "ERROR": "ERROR", "CRITICAL": "ERROR", "FATAL": "ERROR"}
# JSON keys, in the order in which they are tried.
TIME_KEYS = ("timestamp", "time", "date", "@timestamp", "ts", "datetime")
LEVEL_KEYS = ("level", "log_level", "severity", "loglevel", "priority")
MESSAGE_KEYS = ("message", "msg", "content", "text", "log")
SOURCE_KEYS = ("source", "logger", "module", "app", "service")
