"""What language models are asked, by language. The library's own wording; any that gets the answers' shapes will do."""

from __future__ import annotations

ROLE = {"en": "You help to cast the voices of a narrated book. Reply in JSON and nothing else.", "zh": "你负责为有声朗读的书分配角色。只以JSON作答。"}
DISCOVER = {
    "en": 'Who talks in the passage below? Reply {"characters": [{"name": ..., "aliases": [...], "description": ...}]}, one for each person with lines of their own: the usual name, other ways of calling them, and sex, age and manner in a few words. People who are only talked about don\'t count.\n\n{text}',
    "zh": '下面的文字中有谁在说话？请以{"characters": [{"name": ..., "aliases": [...], "description": ...}]}作答，每个有台词的人一项：常用名、别的称呼，以及性别、年龄和语气。只被提到的人不算。\n\n{text}',
}
MERGE = {
    "en": 'People already in the book:\n{known}\n\nPeople found in further chapters:\n{entries}\n\nWhich of the latter are the same person as one of the former, or as each other? Reply {"groups": [{"canonical": ..., "aliases": [...], "description": ...}]}, one for each person among the latter, under the name that the book already has if there is one. A shared family name or title doesn\'t make two people one.',
    "zh": '书中已有的人物：\n{known}\n\n后面章节中找到的人物：\n{entries}\n\n后者中哪些与前者或彼此是同一人？请以{"groups": [{"canonical": ..., "aliases": [...], "description": ...}]}作答，后者中每个人一项；书中已有名字的用原名。同姓或同称谓不等于同一人。',
}
ATTRIBUTE = {
    "en": 'Who says each quote marked (?) in the passage below? A quote is shown as [q<number>](<speaker>) "<words>"; those with a speaker are settled. Speakers:\n{names}\n\nReply {"speakers": [{"quote_id": <number>, "speaker": <a name from the list, or unknown>, "confidence": <0 to 1>{style}}]}.\n\n{text}',
    "zh": '下面的文字中，标有(?)的每句话是谁说的？每句话写作[q<编号>](<说话人>) "<内容>"，已有说话人的不必再答。人物：\n{names}\n\n请以{"speakers": [{"quote_id": <编号>, "speaker": <名单中的名字或unknown>, "confidence": <0到1>{style}}]}作答。\n\n{text}',
}
#: What is asked for besides where a book has styles: every quote's, settled or not.
STYLED = {"en": ', "style": <one of {styles}; also for settled quotes>', "zh": ', "style": <{styles}之一；已有说话人的也要>'}
NOBODY = {"en": "nobody", "zh": "无"}
#: What a designed voice says where its role has too few lines.
SAMPLE = {"en": "It was a quiet morning, and nobody had come down to breakfast yet.", "zh": "那是一个安静的早晨，还没有人下楼吃早饭。"}
