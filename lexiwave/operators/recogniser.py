"""One object from folders of recordings and texts to recognised words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiwave.operators import acoustic, decode, lm, signal, text
from lexiwave.operators.hmm import WordModel
from lexiwave.sources import arpa, corpus
from lexiwave.sources.wav import read_wav

KATZ_FROM_FILE = "katz_arpa"


@dataclass
class Recogniser:
    """Word models, a bigram model for the search and, for a second pass, a model of any order.

    Recordings and texts stay tables; only models, whose size is that of the vocabulary, are on the driver.
    """

    spark: SparkSession
    models: list[WordModel] = field(default_factory=list)
    search_lm: lm.LanguageModel | None = None
    rescore_lm: lm.LanguageModel | None = None
    n_best: int = 1

    def train(self, words_path: str, phones_path: str, turns: int = 100) -> Recogniser:
        """Word models of ``words_path/<word>/topology.txt`` and ``dataset/*.wav``, phones of ``phones_path/<phone>/*.wav``."""
        topologies = corpus.read_topologies(self.spark, f"{words_path}/*/topology.txt")
        phones = self._frames(phones_path).withColumn("phone", corpus.folder(F.col("path"), 1))
        words = self._frames(f"{words_path}/*/dataset").withColumn("folder", corpus.folder(F.col("path"), 2))
        words = words.join(topologies.select("folder", "word"), "folder").withColumnRenamed("path", "utt")
        trained = acoustic.train_monophones(topologies, phones, words, turns)
        self.models = [trained[w] for w in sorted(trained)]
        return self

    def save(self, path: str) -> None:
        corpus.save_tables(acoustic.model_tables(self.spark, self.models), path)

    def restore(self, path: str) -> Recogniser:
        self.models = acoustic.models_of(corpus.load_tables(self.spark, path, list(acoustic.TABLES)))
        return self

    def language_model(self, kind: str, n: int = 2, corpus_path: str | None = None, arpa_path: str | None = None, addition: float = 5, k: int = 5, reserved: float = 0.01) -> lm.LanguageModel:
        """A model trained on a corpus, or with ``katz_arpa`` read from a file."""
        if kind == KATZ_FROM_FILE:
            if arpa_path is None:
                raise ValueError("a model from a file needs the file's path")
            return lm.restored(arpa.read_arpa(self.spark, arpa_path))
        if corpus_path is None:
            raise ValueError("a model is trained on a corpus")
        return lm.train(kind, text.sequences(corpus.read_corpus(self.spark, corpus_path)), n, addition, k, reserved)

    def use(self, search_lm: lm.LanguageModel, rescore_lm: lm.LanguageModel | None = None, n_best: int = 1) -> Recogniser:
        if search_lm.n != 2:
            raise ValueError("the search takes a bigram model")
        if n_best < 1 or (rescore_lm is not None and n_best < 2):
            raise ValueError("n_best is 1 or more, and 2 or more where hypotheses are rescored")
        self.search_lm, self.rescore_lm, self.n_best = search_lm, rescore_lm, n_best
        return self

    def decode(self, wav_path: str, compat: bool = True) -> DataFrame:
        """(utt, words, cost) of every recording under a path: the best hypothesis, after rescoring if there is a second model."""
        if self.search_lm is None or not self.models:
            raise ValueError("decoding takes word models and a bigram model")
        costs = decode.word_costs([m.word for m in self.models], self.search_lm)
        frames = self._frames(wav_path).withColumnRenamed("path", "utt")
        found = decode.recognise(frames, decode.Decoder(self.models, costs, compat=compat), self.n_best if self.rescore_lm is not None else 1)
        if self.rescore_lm is None:
            return found.select("utt", "words", "cost")
        return decode.rescore(found, self.rescore_lm).where("best").select("utt", "words", F.col("second_cost").alias("cost"))

    def search(self, decoded: DataFrame, phrase: str) -> DataFrame:
        """The decoded utterances that hold a phrase."""
        return decoded.where(text.contains_phrase(F.array_join("words", " "), F.lit(text.search_phrase(phrase))))

    def perplexity(self, corpus_path: str) -> tuple[float, float | None]:
        return self._both(lambda model, seqs: model.perplexity(seqs).first()["perplexity"], corpus_path)

    def oov_rate(self, corpus_path: str) -> tuple[float, float | None]:
        return self._both(lambda model, seqs: model.oov_rate(seqs).first()["rate"], corpus_path)

    def _both(self, measure, corpus_path: str) -> tuple[float, float | None]:
        seqs = text.sequences(corpus.read_corpus(self.spark, corpus_path))
        return measure(self.search_lm, seqs), None if self.rescore_lm is None else measure(self.rescore_lm, seqs)

    def _frames(self, path: str) -> DataFrame:
        return signal.mfcc(read_wav(self.spark, path)).select("path", "frame_no", "features")
