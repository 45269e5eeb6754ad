"""Operations on text corpora for preparing training data; nothing else in the package imports them."""
