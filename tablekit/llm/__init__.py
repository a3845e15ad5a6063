"""Operators for preparing training data: texts, archives, chats and codes. Nothing else imports them."""
