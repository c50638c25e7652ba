"""Common words of four languages: anchors of fingerprints, and cues of a language."""

COMMON_WORDS = {
    "en": "the a an and of to in is was are were be been by for from with that this there it on at as or not but have has had he she they you his her their its which who will would can could do does did so if about into than then when what all also".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war im in zu von mit für auf nicht sich es er sie wir ihr als auch an bei aus nach wie dass wird werden hat haben zum zur über".split(),
    "fr": "le la les l un une des du de et ou est sont en dans pour par sur avec qui que ce cette il elle nous vous ne pas plus au aux se sa son ses leur mais comme".split(),
    "es": "el la los las un una unos unas de del y o es son en por para con que se su sus no lo al como más pero este esta fue ha muy le".split(),
}
