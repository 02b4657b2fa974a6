"""A chat session: a plain helper on the driver, for one conversation."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol


class ChatClient(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> dict[str, str]: ...


class HttpChat:
    """One POST for each completion to an /api/chat endpoint, not streamed."""

    def __init__(self, url: str, model: str, options: dict | None = None, timeout: float = 300.0):
        self.url, self.model, self.options, self.timeout = url.rstrip("/"), model, options, timeout

    def complete(self, messages: list[dict[str, str]]) -> dict[str, str]:
        if not messages:
            raise ValueError("no messages")
        body = {"model": self.model, "messages": messages, "stream": False} | ({"options": self.options} if self.options else {})
        request = urllib.request.Request(f"{self.url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            message = json.load(reply).get("message") or {}
        if not message.get("content"):
            raise ValueError("empty reply")
        return {"role": message.get("role") or "assistant", "content": message["content"]}


@dataclass
class Session:
    client: ChatClient
    system: str = ""
    messages: list[dict[str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.reset()

    def send(self, text: str) -> str:
        """The reply; a failed send leaves the user's turn in the history."""
        if not text:
            raise ValueError("empty message")
        self.messages.append({"role": "user", "content": text})
        reply = self.client.complete(list(self.messages))
        self.messages.append(reply)
        return reply["content"]

    def history(self) -> list[dict[str, str]]:
        return [dict(m) for m in self.messages]

    def reset(self) -> None:
        self.messages = [{"role": "system", "content": self.system}] if self.system else []

    def pop_last(self) -> dict[str, str] | None:
        keep = 1 if self.system else 0
        return self.messages.pop() if len(self.messages) > keep else None
