"""Training-data operators: ten corpus-scale components over ``documents`` and friends.

Nothing outside this subpackage imports it; ``spanwright.llm.queries`` holds the
registered queries and their oracle SQL.
"""
