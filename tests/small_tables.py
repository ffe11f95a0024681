"""Where the small test tables lie."""

DATA = "/root/testdata/sf0.001"
