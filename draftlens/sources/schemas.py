"""Types of the nested export format, and its allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the export format.
ENTRY_FORMATS = ("establishment", "addition", "conclusion", "move", "refresh", "subplot")
CARD_NAMESPACES = ("chartype", "goal", "person", "place", "thing", "strength", "weakness", "obstacle",
                   "subplot")
CARD_PRETTY_NAMESPACES = ("Nature", "Goal", "Character", "Place", "Asset", "Strength", "Weakness",
                          "Obstacle", "Subplot")
WILD_EXCHANGES = ("new", "existing")
AUTOTEXT_TYPES = ("pickupCard", "giveCard", "refreshCards", "completedRewardable",
                  "completedRewardableReward", "newSubplot", "rewriteAsset", "discardCard")
ROLE_PATTERN = r"^(?:narrator|character:\d+)"


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """``name:type`` pairs, then nested fields by name."""
    out = T.StructType()
    for item in text.split():
        name, kind = item.split(":")
        out.add(name, kind)
    for name, kind in nested.items():
        out.add(name, kind)
    return out


IMAGE = _struct("url:string attribution_url:string attribution_text:string alt_text:string")
HAND_STACK = _struct("card_id:string stack_size:integer")
HAND = T.ArrayType(HAND_STACK)
# Each side is a list of stacks or the text "unchanged": read as raw text first.
HAND_CONTEXT = _struct("pre:string post:string")
CARD = _struct(
    "card_id:string name:string namespace:string pretty_namespace:string polarity:integer "
    "description:string author_user_pid:string author_character_seq_id:string is_deleted:boolean "
    "is_wild:boolean via_wild_exchanged_for:string is_edited:boolean world_card_id:string "
    "redacted:boolean stack_size:integer challenge_points:integer success_stakes:string "
    "failure_stakes:string suggested_stack_size:integer suggested_success_stakes:string "
    "suggested_failure_stakes:string suggested_challenge_points:integer "
    "suggested_strength_card_id:string suggested_weakness_card_id:string",
    image=IMAGE,
    challenge_points_polarities=T.ArrayType(T.IntegerType()),
)
AUTOTEXT = _struct("type:string to_character_seq_id:string automatic:boolean text:string",
                   card=CARD, new_card=CARD)
SCENE_ENTRY = _struct(
    "user_pid:string seq_id:string format:string pretty_format:string character_seq_id:string "
    "role:string description:string created_at:string challenge_completion_polarity:integer "
    "revisions_requested:boolean revision_request_reason:string "
    "author_is_narrator_when_published:boolean redacted:boolean",
    image=IMAGE, hand_context=HAND_CONTEXT, challenge_cards=T.ArrayType(CARD),
    target_challenge_card=CARD, cards_played_on_challenge=T.ArrayType(CARD), place_card=CARD,
    cards_for_pickup=T.ArrayType(CARD), autotexts=T.ArrayType(AUTOTEXT),
)
STORY = _struct(
    "game_pid:string exported_at:string",
    scenes=T.ArrayType(_struct("", entries=T.ArrayType(_struct("description:string")))),
    characters=T.ArrayType(_struct("character_seq_id:string name:string description:string")),
)

# Words that read as truth values, and what an address must look like.
TRUTHS = ("0", "off", "f", "false", "n", "no", "1", "on", "t", "true", "y", "yes")
URL_PATTERN = (r"^(?i:https?)://(?:[^\s/?#@]*@)?(?:[a-zA-Z0-9_](?:[a-zA-Z0-9_-]*[a-zA-Z0-9_])?(?:\.[a-zA-Z0-9_](?:[a-zA-Z0-9_-]*[a-zA-Z0-9_])?)*\.?"
               r"|\[[0-9a-fA-F:.]+\])(?::[0-9]{1,5})?(?:[/?#]\S*)?$")

# Rules of an entry: field to leaf type, list of one rule, or fields. "!" must be given,
# "?" may be null but not left out.
IMAGE_RULES = {"url": "url", "attribution_url": "url or empty", "attribution_text": "text", "alt_text": "text"}
STACK_RULES = {"card_id!": "text", "stack_size!": "int"}
CARD_RULES = {
    "card_id!": "text", "name": "text", "namespace!": "namespace", "pretty_namespace!": "pretty namespace", "image": IMAGE_RULES, "polarity!": "int",
    "description": "text", "author_user_pid": "text", "author_character_seq_id": "text", "is_deleted!": "bool", "is_wild!": "bool",
    "via_wild_exchanged_for": "exchange", "is_edited": "bool", "world_card_id": "text", "redacted": "bool", "stack_size?": "int",
    "challenge_points": "int", "challenge_points_polarities": ["int"], "success_stakes": "text", "failure_stakes": "text", "suggested_stack_size": "int",
    "suggested_success_stakes": "text", "suggested_failure_stakes": "text", "suggested_challenge_points": "int", "suggested_strength_card_id": "text",
    "suggested_weakness_card_id": "text"}
AUTOTEXT_RULES = {"type!": "autotext type", "to_character_seq_id": "text", "card": CARD_RULES, "new_card": CARD_RULES, "automatic!": "bool", "text!": "text"}
ENTRY_RULES = {
    "user_pid!": "text", "seq_id!": "text", "format!": "format", "pretty_format!": "text", "character_seq_id": "text", "role!": "role", "description": "text",
    "created_at!": "datetime", "image": IMAGE_RULES, "hand_context!": {"pre!": "hand", "post!": "hand"}, "challenge_cards!": [CARD_RULES],
    "target_challenge_card": CARD_RULES, "cards_played_on_challenge!": [CARD_RULES], "challenge_completion_polarity": "int", "place_card": CARD_RULES,
    "cards_for_pickup!": [CARD_RULES], "autotexts!": [AUTOTEXT_RULES], "revisions_requested": "bool", "revision_request_reason": "text",
    "author_is_narrator_when_published!": "bool", "redacted": "bool"}
