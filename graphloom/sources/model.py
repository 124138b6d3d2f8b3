"""A client for language models: prompts and JSON payloads out, JSON answers back. Any function that sends two texts will do."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from graphloom.errors import MissingDependency, ResponseError
from graphloom.prompts import Prompt
from graphloom.sources.wire import answer_model

# Fixed value: separators of payload JSON.
SEPARATORS = (", ", ": ")


def payload_json(data) -> str:
    return json.dumps(data, ensure_ascii=False, separators=SEPARATORS)


class ModelClient:
    """One per task, made by the `make` of ClientExtractor: each pass sends its system prompt and a payload, and returns the answer's text.

    `send(system, user, which)` returns text or None; which names the pass, whose answer has the form of PASSES and answer_model. None and blank answers
    raise ResponseError. `ontology` is the vocabulary that the prompt was rendered with; a casting payload with another one is refused.
    """

    def __init__(self, send: Callable[[str, str, str], str | None], prompt: Prompt, ontology: Mapping):
        if not prompt.rendered:
            raise ValueError("the prompt must be rendered")
        self.send, self.prompt, self.ontology = send, prompt, dict(ontology)

    def _ask(self, system: str, data, which: str) -> str:
        answer = self.send(system, payload_json(data), which)
        if answer is None or not answer.strip():
            raise ResponseError("the model gave no answer")
        return answer

    def extract(self, payload: str) -> str:
        return self._ask(self.prompt.free_extraction_system, json.loads(payload), "extraction")

    def cast(self, payload: str) -> str:
        data = json.loads(payload)
        if data.get("ontology") != self.ontology:
            raise ValueError("the ontology is not the one that the prompt was rendered with")
        return self._ask(self.prompt.ontology_casting_system, data, "casting")

    def contexts(self, payload: str) -> str:
        return self._ask(self.prompt.node_context_system, json.loads(payload), "contexts")


def responses_sender(model: str, client=None) -> Callable[[str, str, str], str | None]:
    """A sender over the public `openai` package, with the pass's form as the answer's; it is imported only here and never on a tested path."""
    if client is None:
        try:
            import openai
        except ImportError as e:
            raise MissingDependency("the openai package is not installed") from e
        client = openai.OpenAI()

    def send(system: str, user: str, which: str) -> str | None:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        answer = client.responses.parse(model=model, input=messages, text_format=answer_model(which)).output_parsed
        return None if answer is None else answer.model_dump_json()

    return send
