"""Digests of the canonical forms of long licence texts.

Made from the files of ``/usr/share/common-licenses`` (Apache-2.0, GPL-2, GPL-3, MPL-2.0, CC0-1.0): as published and with
each paragraph on one line (the canonical form drops lines that begin with "copyright", so line breaks matter), with and
without the appendix after the terms, with links by http and by https.
"""

DIGESTS = {
    "Apache-2.0": [
        "5b8d747dc0052f2f8798f9924ce606a37541fda082569054b71fc45c627b87e6",
        "8198f11c908cf4b9c23f00c8378b69d035e40fee432a3fa0d0e8e8ee22a9ae5d",
        "e3b39bd1a750c71c1bd0b920dc4c762092a3adee4822046579491259535f43db",
        "4948656c2efab2924f9242ef900917b15a560e2018a9e14e3ce208a30b33d4a0",
        "6b85c9ab4bc9fb18c37264b6ed03ada36a58b99e6fb0c43eb26f55e2fdb5820e",
        "5de5f598ec5c05084cc2410c7a0d88da3cfb362027e508eb3efa3bd414128372",
        "3b1e79e05b13b6c373dd4f06964a4d1f11ea9f97be259de05fbaf9b5f94a6e14",
        "2bb246a16f65015c6ec0b0418c7631d35ea1b3210c5d9445750951b66e563c96",
        "69f82329e4a1ae05f3439444460973459eab388dbfff4d1c1ee2f65866b2de30",
        "876320196add5ad7d98ef2822077bf954a1f28d425748beb9b16881f5fe6de8a",
        "b72a5e19a36c67b9fc70a77c62811cb7a220dc62df70634ee78fff3bf245058c",
        "bbebc6395bd1ef5a01904377de0e89a59d5ff535bafc095ec73478b0c8e0a50e",
    ],
    "GPL-2.0": [
        "3cd16e77f28528e9a99eddfaad06ede99b6030b511b6c908e571f93b8b4540f7",
        "16a9c00cc40dfeacc50dd2bca46e50fe1fa539875fca5047325e30487f36c6ed",
        "51007d80929763cdb69b3e115139467d0a53125d8ba8bcfb412bbd9d9dc3e2bf",
        "8dd19406a9c5d894e4c760e830aed6d61ea1a48ba03c653bb7cc29a8d265009e",
        "9d0eee40db66f4aef1c40670f7a352547829287ab75889bf03c10f030ca24b85",
        "bb6e2ff395d6db9b4258f26d84b89aab48969fe2b87d03f9cc3cc46f7c6b5b8d",
    ],
    "GPL-3.0": [
        "2715e9f207c37e8073359989d9d20a1fbbf279e5bb74188c93bf7fb7f134966e",
        "deddef00632501b515d44259c832825335824477a33263dde86696daf6a72106",
        "1e18ba0b0b85662d9a26e5adeb0302937f8cd4bea60cd0dc1d1ebd52177e031b",
        "8b68caec962739cb3f4f3a6deb73c29281658874744203543d3938aef0579df3",
        "3ccab5429f914667367cdcb436938e9e79421c4e1c761393576052ed696da1ca",
        "8b95d55d17dd4d537c3cc774b68da4fa53b2a9b7cab72972f5ae2487e38efd6c",
        "ece8c691aaba2f1f932a70feecc4d1abef5d38e31f77920a7b5327af13f56198",
        "35199e3588187348703dfa5aae2733aaafc99bb3b43ca2eb23946dfb54fd0c28",
    ],
    "MPL-2.0": [
        "db862751263d5122ccc59c7f2eb41bf84dd89c26f8058fba9be387afac130ba0",
        "7c0e4b79c9c38c5f057afcd9d0e1a84f226f2ec7b48989298684cebc8ec4885f",
        "c01ce3e1409f95a4ed8ca27eea1fa347378f87a1af1c7e64fae52dda1f0db7f2",
        "81555f20d199461ac9804f14a659e0b30ef3f942af73175f21862c77b9068798",
        "59960d4a5fda461c9b8c7a6460afa86f388ecc3e9db5b4da1a548ae328f56b63",
    ],
    "CC0-1.0": [
        "bcf1ca6bfc638eb154167518097e0e35e99b24f6b9bb4b2a6cb9b919bfda843a",
        "4492fb7df359ac939041582feac2f9b644ab7fc020475c2e50f52f90a2b43986",
    ],
}
